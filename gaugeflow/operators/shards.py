"""Order-dependent work without one task per group.

A hot source may hold a third of all rows, so nothing here puts a whole source in one task. Rows are
range-sorted over the cluster, given their global rank, and cut into blocks of a fixed number of rows;
each block also gets a halo of its neighbours' rows, so that windows that look a few rows back or ahead
give the same answer as one window over the whole source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gaugeflow.session import cut

#: monotonically_increasing_id holds the partition above this bit and the row below it.
_ROW_BITS = 33


def _ranged(df: DataFrame, order: Sequence[str], distinct: bool = False) -> DataFrame:
    """df range-sorted by order and cut, with _part and _row: its partition and place there.

    Equal rows are in one partition, so that distinct needs no exchange of its own.
    """
    flat = df.repartitionByRange(*order)
    flat = (flat.distinct() if distinct else flat).sortWithinPartitions(*order)
    flat = cut(flat.withColumn("_m", F.monotonically_increasing_id()))
    return flat.withColumns({"_part": F.shiftright("_m", _ROW_BITS), "_row": F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_m")


def rank_blocks(df: DataFrame, order: Sequence[str], block_rows: int, halo: int, distinct: bool = False) -> DataFrame:
    """Add pos (global rank by order), block and core; rows near a block's edge appear in both blocks.

    core is true once for each row, with distinct once for equal rows. The driver only gets a row count for each partition; the table of
    offsets it sends back has 16 bytes a partition.
    """
    if block_rows < 2 * halo or block_rows < 1:
        raise ValueError("a block must hold at least two halos")
    flat = _ranged(df, order, distinct)
    counts = sorted(tuple(r) for r in flat.groupBy("_part").agg(F.count(F.lit(1))).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    at = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    placed = flat.join(F.broadcast(at), "_part").withColumn("pos", F.col("_offset") + F.col("_row"))
    return _in_blocks(placed, df.columns, block_rows, halo)


def _in_blocks(placed: DataFrame, columns: Sequence[str], block_rows: int, halo: int) -> DataFrame:
    """Rows with a global pos, each in its block and as a copy in the neighbour's if it is near the edge."""
    rest = F.pmod(F.col("pos"), F.lit(block_rows))
    home = F.floor(F.col("pos") / block_rows)

    def copy(step: int, when: Column) -> Column:
        return F.when(when, F.struct((home + step).alias("block"), F.lit(step == 0).alias("core")))

    copies = F.array_compact(F.array(copy(0, F.lit(True)), copy(-1, (rest < halo) & (home > 0)), copy(1, rest >= block_rows - halo)))
    return placed.select("*", F.explode(copies).alias("_c")).select(*columns, "pos", "_c.block", "_c.core")


def thinned_blocks(blocks: DataFrame, keep: Column, columns: Sequence[str], block_rows: int, halo: int) -> tuple[DataFrame, DataFrame]:
    """(all core rows, those that keep is true for in blocks of their own): rows of rank_blocks() with keep already known.

    The kept rows hold the order of the first sort: they are counted by block and numbered within, so that no
    second sort over the cluster is needed. blocks is written once and read twice.
    """
    within = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.withColumn("_keep", F.when(F.col("core") & keep, 1).otherwise(0)).withColumn("_nth", F.sum("_keep").over(within))
    rows = cut(rows.filter("core").select(*columns, "block", "_keep", "_nth"))
    counts = rows.groupBy("block").agg(F.sum("_keep").alias("_n"))
    upto = running_total(counts, [], ["block"], "_n", "_upto").select("block", (F.col("_upto") - F.col("_n")).alias("_before"))
    placed = rows.filter("_keep = 1").join(upto, "block").withColumn("pos", F.col("_before") + F.col("_nth") - 1)
    return rows.select(*columns), _in_blocks(placed, columns, block_rows, halo)


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add name: the sum of value over this and all earlier rows of the group, by order.

    A prefix sum in two levels: each range partition sums its own rows by group, the sums of the parts
    before are added. A group's sums are as many as its partitions, so the windows over them are small.
    Rows that tie in order are taken in the order in which the range sort left them.
    """
    flat = _ranged(df, [*groups, *order])
    keys = [*groups, "_part"]
    parts = flat.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    local = flat.withColumn("_own", F.sum(value).over(Window.partitionBy(*keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)))
    same = [local[k].eqNullSafe(parts[k]) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    return local.join(parts, condition).select(*[local[c] for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))


def _packed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> tuple[DataFrame, list[str], list[str]]:
    """df as one struct _whole, with its keys and order beside it under names of their own."""
    ks, os = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    flat = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_whole"), *[F.col(k).alias(n) for k, n in zip(keys, ks, strict=True)], *[c.alias(n) for c, n in zip(columns, os, strict=True)])
    return flat, ks, os


def _unpacked(rows: DataFrame, columns: Sequence[str], new: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col("_whole")[c].alias(c) for c in columns if c not in new], *new)


def along(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Callable[[Callable[[str], Column], WindowSpec], dict[str, Column]], reach: int = 1, block_rows: int = 65536) -> DataFrame:
    """df with columns that look at most reach rows back or ahead in their series, for series of any size.

    columns(value, w) gives the new columns; value(name) is a column of df, w the window along a series.
    """
    flat, ks, os = _packed(df, keys, order)
    blocks = rank_blocks(flat, [*ks, *os], block_rows, halo=reach)
    new = columns(lambda name: F.col("_whole")[name], Window.partitionBy("block", *ks).orderBy("pos"))
    return _unpacked(blocks.withColumns(new).filter("core"), df.columns, list(new))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, before: str, after: str, block_rows: int = 65536) -> DataFrame:
    """df with before and after: the last value that isn't null at or before a row of its series, and the first at or after it.

    Inside a block by windows; over blocks the first and last values of each series in each block are carried, one
    row for a block, so that a series may be of any size.
    """
    flat, ks, os = _packed(df, keys, order)
    flat = flat.withColumn("_v", F.col("_whole")[value])
    blocks = rank_blocks(flat, [*ks, *os], block_rows, halo=0)
    known = F.when(F.col("_v").isNotNull(), F.col("pos"))
    ends = blocks.groupBy("block", *ks).agg(F.max_by("_v", known).alias("_last"), F.min_by("_v", known).alias("_first"))
    back, ahead = (Window.partitionBy(*ks).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("block", F.desc("block")))
    ends = ends.select(*[F.col(c).alias(f"_{c}") for c in ("block", *ks)], F.last("_last", ignorenulls=True).over(back).alias("_b"), F.last("_first", ignorenulls=True).over(ahead).alias("_a"))
    # from the end on, a window ahead is one back: no frame is read again for each row
    forth, home = (Window.partitionBy("block", *ks).orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in ("pos", F.desc("pos")))
    rows = blocks.withColumns({"_own_b": F.last("_v", ignorenulls=True).over(forth), "_own_a": F.last("_v", ignorenulls=True).over(home)})
    same = F.col("block") == F.col("_block")
    for k in ks:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = rows.join(ends, same).withColumns({before: F.coalesce("_own_b", "_b"), after: F.coalesce("_own_a", "_a")})
    return _unpacked(rows, df.columns, [before, after])
