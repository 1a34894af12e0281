"""Delimited sensor files: decoding, all-text reading, names, times and quality flags."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.instants import to_instants

#: Encodings in the order in which they are tried.
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")
#: Names of the column that holds the time, best first.
TIME_NAMES = ("timestamp", "datetime", "date_time", "time", "date", "iso_timestamp")


def decode(content: bytes, encodings: Sequence[str] = ENCODINGS) -> tuple[str, str]:
    """(text, encoding): the first encoding that fits."""
    for name in encodings:
        try:
            return content.decode(name), name
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def lines_of(name: str, content: bytes, separator: str = ",") -> tuple[list[list[str]], str]:
    """(lines, encoding) of a delimited file, or of the first sheet of a workbook if a reader is installed."""
    if name.lower().endswith((".xls", ".xlsx")):
        sheet = pd.read_excel(io.BytesIO(content), header=None, dtype=str).fillna("")
        return sheet.to_numpy(object).tolist(), "workbook"
    text, encoding = decode(content)
    return [line for line in csv.reader(io.StringIO(text), delimiter=separator) if line], encoding


def header_and_sample(content: bytes, rows: int = 5, separator: str = ",") -> tuple[list[str], list[list[str]]]:
    """The header and the first rows of a file's bytes."""
    lines = csv.reader(io.StringIO(decode(content)[0]), delimiter=separator)
    table = [line for line, _ in zip(lines, range(rows + 1), strict=False)]
    return (table[0], table[1:]) if table else ([], [])


def read_any_encoding(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """(path, line_no, encoding, cells, names): each line of each file below path as an array of texts.

    Files are decoded where they are read, one at a time; one that can't be parsed, such as a workbook without
    an installed reader, gives one row with null cells, an empty one none.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    lines, encoding = lines_of(name, bytes(content), separator)
                except (ValueError, csv.Error, ImportError, OSError):
                    lines, encoding = [], None
                head, rest = (lines[0], lines[1:]) if lines else ([], [None])
                for at in range(0, len(rest), 10_000):
                    some = rest[at : at + 10_000]
                    yield pd.DataFrame({"path": name, "line_no": range(at + 1, at + 1 + len(some)), "encoding": encoding, "cells": some, "names": [head] * len(some)})

    return files.mapInPandas(parse, "path string, line_no bigint, encoding string, cells array<string>, names array<string>")


def read_text_columns(spark: SparkSession, path: str, names: Sequence[str], separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header, bound to names by position, all columns texts: flags like 000 stay whole."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=True, sep=separator, encoding=encoding, mode="PERMISSIVE")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, timestamp, value, x, y) of a semicolon file of time, point, x, y, value; a point's last place counts."""
    rows = read_text_columns(spark, path, ["time", "point_id", "x", "y", "value"], ";")
    when = F.coalesce(*[F.try_to_timestamp("time", F.lit(f)) for f in ("dd.MM.yyyy HH:mm:ss.SSSSSS", "dd.MM.yyyy HH:mm:ss.SSS", "dd.MM.yyyy HH:mm:ss")])
    rows = rows.select("point_id", when.alias("timestamp"), *[F.col(c).try_cast("double").alias(c) for c in ("x", "y", "value")], F.monotonically_increasing_id().alias("_n"))
    place = rows.groupBy("point_id").agg(F.max_by(F.struct("x", "y"), "_n").alias("_p"))
    return rows.drop("x", "y", "_n").join(place, "point_id").select("point_id", "timestamp", "value", "_p.x", "_p.y")


def clean_names(names: Sequence[str]) -> list[str]:
    """Lower case; lat... and lon... become lat and lon; runs of other characters than words one underscore."""
    import re

    out = []
    for name in names:
        low = name.strip().lower()
        low = "lat" if low.startswith("lat") else "lon" if low.startswith("lon") else low
        out.append(re.sub(r"[^\w]+", "_", low).strip("_") or name)
    return out


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def time_column(columns: Sequence[str], candidates: Sequence[str] = TIME_NAMES) -> str | None:
    """The first column named as a candidate, else the first that contains one."""
    low = {c: c.lower() for c in columns}
    return next((c for c in columns if low[c] in candidates), None) or next((c for c in columns if any(k in low[c] for k in candidates)), None)


def with_instants(df: DataFrame, key: str, candidates: Sequence[str] = TIME_NAMES) -> DataFrame:
    """df with iso_timestamp of its time column, rows without an instant left out."""
    name = time_column(df.columns, candidates)
    if name is None:
        raise ValueError("no column holds a time")
    found = to_instants(df.withColumn("_src", F.lit("file")), source="_src", key=key, text=name).filter("utc_us is not null")
    iso = F.date_format(F.timestamp_micros("utc_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return df.join(found.select(F.col("key").alias(key), iso.alias("iso_timestamp")).dropDuplicates([key]), key)


def quality_flag(flag: Column, wide: Column) -> Column:
    """1 for good, 0 for bad. In a table with wide flags (of several characters) only all zeros are good;
    else a flag is its number, and one that is none is good."""
    return F.when(wide, F.when(F.trim(flag).rlike("^0+$"), 1).otherwise(0)).otherwise(F.coalesce(flag.try_cast("int"), F.lit(1)))


def with_quality(df: DataFrame, flag: str | None = "qc") -> DataFrame:
    """df with an int column qc; 1 throughout if there is no flag. Whether flags are wide is one aggregate."""
    if flag is None or flag not in df.columns:
        return df.withColumn("qc", F.lit(1))
    text = F.trim(F.col(flag).cast("string"))
    wide = df.agg(F.coalesce(F.max(F.length(text)) > 1, F.lit(False)).alias("_wide"))
    return df.crossJoin(F.broadcast(wide)).withColumn("qc", quality_flag(text, F.col("_wide"))).drop("_wide")


def dataset_metadata(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, n_rows, start, end, lon_min, lat_min, lon_max, lat_max, epsg) of readings with iso_timestamp, lat, lon."""
    number = {c: F.col(c).try_cast("double") for c in ("lon", "lat") if c in df.columns}
    box = [f(number[c]).alias(n) if c in number else F.lit(None).cast("double").alias(n) for f, c, n in ((F.min, "lon", "lon_min"), (F.min, "lat", "lat_min"), (F.max, "lon", "lon_max"), (F.max, "lat", "lat_max"))]
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows"), F.min("iso_timestamp").alias("start"), F.max("iso_timestamp").alias("end"), *box).withColumn("epsg", F.lit("EPSG:4326"))


def schema_report(df: DataFrame) -> list[dict[str, str]]:
    """[{name, type}] with the types number and text."""
    numbers = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return [{"name": n, "type": "number" if t in numbers or t.startswith("decimal") else "text"} for n, t in df.dtypes]
