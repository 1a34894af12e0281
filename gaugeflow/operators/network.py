"""Acquisition networks: pairs of dates, their components, the best thresholds, and repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.shards import running_total
from gaugeflow.session import cut


def date_pairs(dates: DataFrame, days: int, metres: float) -> DataFrame:
    """(ref, rep, baseline, duration, pair) of dates (date, baseline) at most days and metres apart, ref first.

    Dates are matched by window of days, so that only dates at most two windows apart meet.
    """
    width = max(days, 1)
    bucket = F.floor(F.unix_date("date") / width)
    a = dates.select(F.col("date").alias("ref"), F.col("baseline").alias("_a"), F.explode(F.array(bucket, bucket + 1)).alias("_w"))
    b = dates.select(F.col("date").alias("rep"), F.col("baseline").alias("_b"), bucket.alias("_w"))
    pairs = a.join(b, "_w").withColumns({"baseline": F.col("_b") - F.col("_a"), "duration": F.datediff("rep", "ref")})
    pairs = pairs.filter((F.col("ref") < F.col("rep")) & (F.col("duration") <= days) & (F.abs("baseline") <= metres))
    return pairs.select("ref", "rep", "baseline", "duration", F.concat_ws(" ", F.col("ref").cast("string"), F.col("rep").cast("string")).alias("pair"))


def degrees(pairs: DataFrame) -> DataFrame:
    """(date, degree): the pairs that each date is an end of."""
    ends = pairs.select(F.col("ref").alias("date")).unionAll(pairs.select(F.col("rep").alias("date")))
    return ends.groupBy("date").agg(F.count(F.lit(1)).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's connected component.

    nodes: node; edges: a, b. Alternating large-star and small-star steps join each node to the least node of
    its neighbourhood; a graph of n nodes needs about log2(n) rounds, whatever its diameter. Each round is
    cut, and rounds go on until nothing changes. Edges to unknown nodes count; loops, nulls and repeats do
    nothing; a null node is a component of its own.
    """
    def each(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        """(u, v) of all the ends of each row; no union, which can't be planned over every checkpoint."""
        return rows.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends])).alias("_e")).select("_e.*")

    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null and u != v")
    links = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = each(links, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = cut(each(large.join(small, "u"), ("u", "m"), ("v", "m")).filter("u != v").distinct())
        if new.count() == links.count() and not new.join(links, ["u", "v"], "left_anti").limit(1).count():
            break
        links = new
    return nodes.select("node").distinct().join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def require_connected(dates: DataFrame, pairs: DataFrame) -> None:
    """Raise unless the pairs (ref, rep) join all dates (date); the message names the first ten cut off."""
    found = components(dates.select(F.unix_date("date").alias("node")), pairs.select(F.unix_date("ref").alias("a"), F.unix_date("rep").alias("b")))
    main = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    cut_off = found.join(main.select("component"), "component", "left_anti").select(F.date_from_unix_date("node").alias("date")).orderBy("date").limit(10)
    if names := [str(r.date) for r in cut_off.collect()]:
        raise ValueError(f"the network is not connected; cut off: {', '.join(names)}")


def network_grid(dates: DataFrame, days: Sequence[int], metres: Sequence[float]) -> DataFrame:
    """(days, metres, n_pairs, n_components) of each combination of thresholds; null dates are left out.

    All combinations are searched together: a node is a date in one combination.
    """
    grid = [(i, d, float(m)) for i, (d, m) in enumerate((d, m) for d in days for m in metres)]
    listed = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(d).alias("days"), F.lit(m).alias("metres")) for i, d, m in grid])
    known = dates.filter("date is not null")

    def node(day: str) -> Column:
        return F.shiftleft(F.col("g").cast("bigint"), 32) + F.unix_date(day)

    pairs = date_pairs(known, max(days), float(max(metres)))
    fits = F.filter(listed, lambda t: (F.col("duration") <= t.days) & (F.abs("baseline") <= t.metres))
    pairs = cut(pairs.select("ref", "rep", F.explode(fits).alias("_t")).select("ref", "rep", F.col("_t.g").alias("g")))
    nodes = known.select("date", F.explode(listed).alias("_t")).select("date", F.col("_t.g").alias("g"))
    found = components(nodes.select(node("date").alias("node")), pairs.select(node("ref").alias("a"), node("rep").alias("b")))
    of = F.shiftright(F.col("component") + (1 << 31), 32).cast("int").alias("g")
    n_components = found.groupBy(of).agg(F.countDistinct("component").alias("n_components"))
    n_pairs = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("n_pairs"))
    rows = dates.sparkSession.createDataFrame(grid, "g int, days int, metres double")  # one row a combination
    rows = rows.join(n_pairs, "g", "left").join(n_components, "g", "left")
    return rows.select("days", "metres", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_pairs", "n_components")])


def best_network(grid: DataFrame) -> DataFrame:
    """The connected network with the fewest pairs, else the least fragmented one; then the tightest thresholds."""
    return grid.orderBy(F.when(F.col("n_components") == 1, 0).otherwise(F.col("n_components")), "n_pairs", "days", "metres").limit(1)


def bridges(dates: DataFrame, pairs: DataFrame, candidates: DataFrame, *, max_days: float, max_metres: float, max_bridge: float = 400.0) -> DataFrame:
    """The candidates (as pairs, with cost) that join the components of a network at the least cost.

    Cost is the share of the thresholds that a pair uses; baselines beyond max_bridge are no candidates, ties go
    by dates. The order is strict, so the least-cost forest between components is the only one: in each round
    every component takes its cheapest way out, and what that joins is one component in the next round.
    Rounds at least halve the components that can still be joined; nothing is gathered.
    """
    near = candidates.filter(F.abs("baseline") <= max_bridge)
    near = cut(near.withColumn("cost", F.col("duration") / max_days + F.abs("baseline") / max_metres))
    day = {c: F.unix_date(c) for c in ("date", "ref", "rep")}
    groups = components(dates.select(day["date"].alias("node")), pairs.select(day["ref"].alias("a"), day["rep"].alias("b")))
    groups = cut(groups.filter("node is not null"))
    taken = near.limit(0)
    while True:
        ends = near
        for side in ("ref", "rep"):
            ends = ends.join(groups.select(F.date_from_unix_date("node").alias(side), F.col("component").alias(f"_{side}")), side)
        ways = ends.filter("_ref != _rep").withColumn("_way", F.struct("cost", "ref", "rep"))
        ways = ways.select("_way", "_ref", "_rep", F.explode(F.array("_ref", "_rep")).alias("_from"))
        best = cut(ways.groupBy("_from").agg(F.min(F.struct("_way", "_ref", "_rep")).alias("_b")).select("_b.*").distinct())
        if not best.limit(1).count():
            return taken
        chosen = best.select("_way.ref", "_way.rep")
        taken = cut(taken.unionByName(near.join(chosen, ["ref", "rep"], "left_semi")))
        joined = components(groups.select(F.col("component").alias("node")), best.select(F.col("_ref").alias("a"), F.col("_rep").alias("b")))
        groups = cut(groups.join(joined.withColumnRenamed("node", "_old").withColumnRenamed("component", "_new"), F.col("component") == F.col("_old")).select("node", F.col("_new").alias("component")))


def repair(dates: DataFrame, pairs: DataFrame, candidates: DataFrame, *, max_days: float, max_metres: float, max_bridge: float = 400.0, max_dropped: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A network (dates: date; pairs, candidates: ref, rep, baseline, duration, pair) made whole: (pairs, bridges, dropped dates).

    Bridges are added, then the dates outside the largest component are dropped with their pairs; of equal ones
    that with the earliest date stays. Raises if that drops more than the share max_dropped of the dates.
    Repeated dates count once, null dates are left out, a network without dates stays empty.
    """
    known = cut(dates.select("date").filter("date is not null").distinct())
    added = bridges(known, pairs, candidates, max_days=max_days, max_metres=max_metres, max_bridge=max_bridge)
    whole = cut(pairs.unionByName(added.select(*pairs.columns)))
    found = cut(components(known.select(F.unix_date("date").alias("node")), whole.select(F.unix_date("ref").alias("a"), F.unix_date("rep").alias("b"))))
    main = found.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    keep = found.join(main.select("component"), "component", "left_semi").select(F.date_from_unix_date("node").alias("date"))
    keep = cut(keep.join(known, "date", "left_semi"))
    dropped = known.join(keep, "date", "left_anti")
    n, lost = known.count(), dropped.count()
    if lost > max_dropped * n:
        raise ValueError(f"no connected network: {lost} of {n} dates cannot be bridged")
    for side in ("ref", "rep"):
        whole = whole.join(keep.select(F.col("date").alias(side)), side, "left_semi")
    return whole, added, dropped


def ordinals(pairs: DataFrame) -> DataFrame:
    """pairs (ref, rep, ...) with ref_index and rep_index: places from 0 among all dates of the network, in order."""
    dates = pairs.select(F.explode(F.array("ref", "rep")).alias("date")).filter("date is not null").distinct().withColumn("_one", F.lit(1))
    numbered = running_total(dates, [], ["date"], "_one", "_n")
    for side in ("ref", "rep"):
        pairs = pairs.join(numbered.select(F.col("date").alias(side), (F.col("_n") - 1).alias(f"{side}_index")), side, "left")
    return pairs
