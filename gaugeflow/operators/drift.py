"""Schemas that drift between files: a catalogue of column lifespans, the list of changes, one table of all.

Files of a feed are put in order and ranked; a field's presence in consecutive files of its feed is an
island. Where an island begins a field was added, where it ends removed; inside it, a change of name or type
from one file to the next is logged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow.functions.columns import normal_name
from gaugeflow.functions.units import QUANTITIES
from gaugeflow.operators.common_units import quantity_columns, to_common_units
from gaugeflow.operators.shards import rank_blocks

#: Declared types and the Spark type that holds them all.
TYPES = {"number": "double", "integer": "bigint", "datetime": "timestamp", "date": "date", "boolean": "boolean", "text": "string"}


def _fields(headers: DataFrame, *more: str) -> DataFrame:
    """(file_id, field, name, type): one row for each field of a file; a field is a quantity or a column's own name.

    If several columns of a file are the same field, the one with the lowest ordinal counts.
    """
    named = headers.select("file_id", "ordinal", normal_name(F.col("name")).alias("name"), F.coalesce(F.lower(F.trim("type")), F.lit("")).alias("type")).filter("name is not null").distinct()
    held = quantity_columns(headers).select(F.col("file_id").alias("_file"), F.col("ordinal").alias("_ordinal"), F.col("normal").alias("_name"), "quantity")
    on = named.file_id.eqNullSafe(held._file) & named.ordinal.eqNullSafe(held._ordinal) & (named.name == held._name)
    named = named.join(held, on, "left").withColumn("field", F.coalesce(F.concat(F.lit("quantity:"), "quantity"), "name"))
    first = named.groupBy("file_id", "field").agg(F.min(F.struct("ordinal", "name", "type")).alias("_c"))
    return first.select("file_id", "field", "_c.name", "_c.type", *[f"_c.{c}" for c in more])


def _placed(files: DataFrame, block_files: int) -> DataFrame:
    """(feed, file_id, period_start, pos, block, core, before, after): each file's place and its feed's neighbours."""
    rows = files.select("feed", "period_start", "file_id").filter("feed is not null and file_id is not null")
    blocks = rank_blocks(rows, ["feed", "period_start", "file_id"], block_files, halo=2, distinct=True)
    w = Window.partitionBy("block", "feed").orderBy("pos")
    return blocks.withColumns({"before": F.lag("file_id").over(w), "after": F.lead("file_id").over(w)})


def column_changes(files: DataFrame, headers: DataFrame, block_files: int = 50_000) -> DataFrame:
    """Changes of each file's header against the file before it in its feed: (file_id, change, old_name, new_name).

    files: file_id, feed, period_start; headers: file_id, ordinal, name, type. Files are ordered by
    period_start, then file_id. change is 'added' (old_name ''), 'removed' (new_name ''), 'renamed' (the same
    quantity under another normal name) or 'retyped' (the same field with another type, case apart); one
    field can be renamed and retyped. The order of columns is no change. The first file of a feed has none;
    a file without a header has lost all fields. Null feeds, file ids and names fall away, a null type is an
    empty one, repeated rows count once, other columns are ignored, empty tables give an empty result.
    """
    placed = _placed(files, block_files)
    rows = placed.join(_fields(headers), "file_id")
    w = Window.partitionBy("block", "feed", "field").orderBy("pos")
    near = {f"_{c}_{k}": f(c).over(w) for c in ("pos", "name", "type") for k, f in (("old", F.lag), ("new", F.lead))}
    rows = rows.withColumns(near)
    stays = F.coalesce(F.col("_pos_old") == F.col("pos") - 1, F.lit(False))
    goes = F.coalesce(F.col("_pos_new") != F.col("pos") + 1, F.lit(True)) & F.col("after").isNotNull()

    def change(kind: str, file: str, old: Column, new: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.col(file).alias("file_id"), F.lit(kind).alias("change"), old.alias("old_name"), new.alias("new_name")))

    none, name = F.lit(""), F.col("name")
    changes = F.array_compact(
        F.array(
            change("added", "file_id", none, name, F.col("core") & ~stays & F.col("before").isNotNull()),
            change("renamed", "file_id", F.col("_name_old"), name, F.col("core") & stays & (F.col("_name_old") != name)),
            change("retyped", "file_id", F.col("_name_old"), name, F.col("core") & stays & (F.col("_type_old") != F.col("type"))),
            # told by the last file that has the field; that file's block knows the file after it
            change("removed", "after", name, none, F.col("core") & goes),
        )
    )
    return rows.select(F.explode(changes).alias("_c")).select("_c.*")


def column_lifespans(files: DataFrame, headers: DataFrame, block_files: int = 50_000) -> DataFrame:
    """Catalogue: (feed, field, name, type, first_file, last_file, first_period, last_period, n_files, ended_by, cast_to).

    One row for each island, a stretch of consecutive files of a feed that hold a field under one name and type; a
    column that ends and returns has two. ended_by is the file without it that comes next, null if the feed ends
    with it. cast_to is the type that holds all values of the field in all feeds, see `field_types`. Files and
    headers are read as in `column_changes`.
    """
    placed = _placed(files, block_files).filter("core").select("feed", "file_id", "period_start", "pos", "block", "after")
    rows = placed.join(_fields(headers), "file_id")
    key = ["feed", "field", "name", "type"]
    # islands inside blocks of files first, then those that meet at a block's edge are joined
    nth = F.row_number().over(Window.partitionBy("block", *key).orderBy("pos"))
    ends = [F.min(F.struct("pos", "file_id", "period_start")).alias("first"), F.max(F.struct("pos", "file_id", "period_start", "after")).alias("last")]
    parts = rows.withColumn("_island", F.col("pos") - nth).groupBy("block", *key, "_island").agg(*ends, F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy("first.pos")
    new = F.coalesce(F.lag("last.pos").over(w) != F.col("first.pos") - 1, F.lit(True)).cast("int")
    parts = parts.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = parts.groupBy(*key, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n_files"))
    spans = spans.select(
        *key, F.col("first.file_id").alias("first_file"), F.col("last.file_id").alias("last_file"), F.col("first.period_start").alias("first_period"),
        F.col("last.period_start").alias("last_period"), "n_files", F.col("last.after").alias("ended_by"),
    )
    return spans.join(field_types(headers), "field")


def field_types(headers: DataFrame) -> DataFrame:
    """(field, cast_to): the Spark type that holds a field's values, by the table of declared types.

    Quantities are doubles; a field declared with one type has that, with integer and number a double, with
    other mixtures or an unknown type it is a string.
    """
    table = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    held = F.coalesce(F.try_element_at(table, F.col("type")), F.lit("string"))
    casts = _fields(headers).groupBy("field").agg(F.collect_set(held).alias("_types"))  # at most one of each type
    numbers = F.size(F.array_except("_types", F.array(F.lit("double"), F.lit("bigint")))) == 0
    quantity = F.col("field").startswith("quantity:")
    return casts.select("field", F.when(quantity, "double").when(F.size("_types") == 1, F.col("_types")[0]).when(numbers, "double").otherwise("string").alias("cast_to"))


def typed_cells(records: DataFrame, headers: DataFrame) -> DataFrame:
    """(record_id, file_id, line_no, field, cast_to, number, instant, text): the cells of plain columns, cast by `field_types`.

    number holds values cast to double, bigint or boolean (1 and 0), instant those cast to timestamp or date, text
    those cast to string and those whose cast failed. Quantities are left to `to_common_units`; null and missing
    cells give no row, repeated lines count once.
    """
    lines = records.select("record_id", "file_id", "line_no", "cells").distinct()
    plain = _fields(headers, "ordinal").filter(~F.col("field").startswith("quantity:")).join(field_types(headers), "field")
    plain = plain.groupBy("file_id").agg(F.collect_list(F.struct("field", "ordinal", "cast_to")).alias("_plain"))  # as long as a header
    cells = lines.join(plain, "file_id").select("record_id", "file_id", "line_no", F.explode(F.transform("_plain", lambda p: F.struct(p["field"].alias("field"), p["cast_to"].alias("cast_to"), F.get("cells", p["ordinal"] - 1).alias("raw")))).alias("_c"))
    cells = cells.select("record_id", "file_id", "line_no", "_c.*").filter("raw is not null")
    kind, raw = F.col("cast_to"), F.col("raw")
    number = F.when(kind == "double", raw.try_cast("double")).when(kind == "bigint", raw.try_cast("bigint").cast("double")).when(kind == "boolean", raw.try_cast("boolean").cast("double"))
    cells = cells.withColumns({"number": number, "instant": F.when(kind.isin("timestamp", "date"), raw.try_cast("timestamp"))})
    text = F.when(F.col("number").isNull() & F.col("instant").isNull(), raw)
    return cells.select("record_id", "file_id", "line_no", "field", "cast_to", "number", "instant", text.alias("text"))


#: Plain fields that one table may have as columns; they are names in headers, not values.
MOST_FIELDS = 10_000


def one_table(records: DataFrame, headers: DataFrame) -> DataFrame:
    """All files' lines in one table: (record_id, file_id, line_no, <the five quantities>, <plain fields>, others).

    The quantities are doubles in common units, whatever their column was called. Each other field is a column
    of the type of `field_types`, with a _ after its name where the name is taken; others maps fields to the texts
    that could not be cast. Repeated lines count once; lines of files without a header keep nulls. Headers with
    more than MOST_FIELDS plain fields are refused: use `typed_cells`, which has no such bound.
    """
    lines = records.select("record_id", "file_id", "line_no").distinct()
    kinds = field_types(headers).filter(~F.col("field").startswith("quantity:")).orderBy("field").limit(MOST_FIELDS + 1).collect()
    if len(kinds) > MOST_FIELDS:
        raise ValueError("too many fields for columns")
    taken = {"record_id", "file_id", "line_no", "others", *QUANTITIES}
    values = to_common_units(records, headers).groupBy("record_id").agg(*[F.max(F.when(F.col("quantity") == q, F.col("value"))).alias(q) for q in QUANTITIES])
    columns = []
    for field, kind in kinds:
        column = "number" if kind in ("double", "bigint", "boolean") else "instant" if kind in ("timestamp", "date") else "text"
        columns.append(F.max(F.when(F.col("field") == field, F.col(column))).cast(kind).alias(f"{field}_" if field in taken else field))
    failed = F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list(F.when((F.col("cast_to") != "string") & F.col("text").isNotNull(), F.struct("field", "text"))))))
    plain = typed_cells(records, headers).groupBy("record_id").agg(*columns, failed.alias("others"))
    return lines.join(values, "record_id", "left").join(plain, "record_id", "left").select("record_id", "file_id", "line_no", *QUANTITIES, *[c for c in plain.columns if c != "record_id"])


#: Beginnings of the type names in a Parquet footer's schema, and what they are called here.
FOOTER_TYPES = {"int": "integer", "uint": "integer", "double": "number", "float": "number", "halffloat": "number", "decimal": "number", "timestamp": "datetime", "date": "date", "bool": "boolean"}


def footer_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, modified, ordinal, name, type): the columns in the footers of all Parquet files below a folder.

    Only footers are read, by the executors, each file's once. A file without a readable footer has one row with
    a null ordinal and name and the type 'unreadable'.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "modificationTime")

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import ArrowInvalid, fs

        for part in parts:
            rows = []
            for file, modified in zip(part["path"], part["modificationTime"], strict=True):
                system, at = fs.FileSystem.from_uri("file://" + file[5:] if file.startswith("file:/") and not file.startswith("file://") else file)
                try:
                    fields = list(pq.read_schema(at, filesystem=system))
                except (ArrowInvalid, OSError):
                    rows.append((file, modified, None, None, "unreadable"))
                    continue
                for n, f in enumerate(fields, 1):
                    kind = next((k for start, k in FOOTER_TYPES.items() if str(f.type).startswith(start)), "text")
                    rows.append((file, modified, n, f.name, kind))
            yield pd.DataFrame(rows, columns=["file", "modified", "ordinal", "name", "type"]).astype({"ordinal": "Int32"})

    return listed.mapInPandas(read, "file string, modified timestamp, ordinal int, name string, type string")
