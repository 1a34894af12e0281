"""From files that arrive to tables: scan, route, read, check, archive, and import with counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators import catalog, joins
from gaugeflow.sources import detect, sinks, text_files
from gaugeflow.sources.settings import DataError

#: What metadata of ingested data holds unless it says otherwise.
DEFAULTS = {"type": "in_situ", "format": "file", "crs": "EPSG:4326", "mode": "batch", "data_source": "sensor"}


def scan(spark: SparkSession, folder: str, pattern: str = "*.{csv,txt,xls,xlsx}") -> DataFrame:
    """(path, name, length, modified) of the files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def with_defaults(metadata: DataFrame, defaults: Mapping[str, object] = DEFAULTS) -> DataFrame:
    """metadata with each default where its column is null or not there; what is there stays."""
    there = set(metadata.columns)
    return metadata.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in there else F.lit(v) for c, v in defaults.items()})


def archive(files: DataFrame, folder: str) -> DataFrame:
    """(path, target, error): move files (path) below folder, by the executors.

    A task that runs again finds its files moved, which is no error; a file that is nowhere has one.
    """

    def move(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        uri = lambda p: "file://" + p[5:] if p.startswith("file:/") and not p.startswith("file://") else p if "://" in p else f"file://{p}"
        for part in parts:
            rows = []
            for path in part["path"]:
                target = f"{folder.rstrip('/')}/{path.rsplit('/', 1)[-1]}"
                try:
                    system, at = fs.FileSystem.from_uri(uri(path))
                    to = fs.FileSystem.from_uri(uri(target))[1]
                    system.create_dir(to.rsplit("/", 1)[0])
                    if system.get_file_info(at).type != fs.FileType.NotFound or system.get_file_info(to).type == fs.FileType.NotFound:
                        system.move(at, to)
                    rows.append((path, target, None))
                except (OSError, ValueError) as error:
                    rows.append((path, None, str(error)))
            yield pd.DataFrame(rows, columns=["path", "target", "error"])

    return files.select("path").mapInPandas(move, "path string, target string, error string")


@dataclass
class Ingested:
    """rows of good files, one row a file with its state, and where files went."""

    rows: DataFrame
    files: DataFrame
    archived: DataFrame


def ingest(spark: SparkSession, folder: str, out: str, processed: str) -> Ingested:
    """Read every file of a folder, keep the lines of those that can be read and told, and archive all of them.

    out/rows gets (path, line_no, cells, names, sensor_type), out/files (path, name, n_lines, sensor_type, encoding,
    state) with the state 'loaded' or 'quarantined' (not readable, empty or of no known type). Files are moved
    only after both tables are written, good and quarantined ones alike; an empty folder gives empty tables.
    """
    listed = scan(spark, folder)
    lines = text_files.read_any_encoding(spark, folder) if listed.limit(1).count() else spark.createDataFrame([], "path string, line_no bigint, encoding string, cells array<string>, names array<string>")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    lines = lines.withColumn("sensor_type", detect.sensor_type(name, F.col("names")))
    good = F.col("cells").isNotNull() & F.col("sensor_type").isNotNull()
    lines.filter(good).drop("encoding").write.mode("append").parquet(f"{out}/rows")
    told = lines.groupBy("path").agg(F.count_if(F.col("cells").isNotNull()).alias("n_lines"), F.first("sensor_type").alias("sensor_type"), F.first("encoding").alias("encoding"))
    files = listed.select("path", "name").join(told, "path", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    state = F.when((F.col("n_lines") > 0) & F.col("sensor_type").isNotNull(), "loaded").otherwise("quarantined")
    # a written list: the folder is empty when the files have moved
    files.withColumn("state", state).write.mode("overwrite").parquet(f"{out}/files")
    files = spark.read.parquet(f"{out}/files")
    archive(files, processed).write.mode("append").parquet(f"{out}/archived")
    return Ingested(spark.read.parquet(f"{out}/rows"), files, spark.read.parquet(f"{out}/archived"))


def count_checks(table: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, n, expected, ok): rows of a table by key against the numbers expected (key, expected)."""
    got = table.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = expected.join(got, key, "full").select(key, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "expected")])
    return rows.withColumn("ok", F.col("n") == F.col("expected"))


def load_readings(readings: DataFrame, table: str, *, lon: str = "lon", lat: str = "lat", key: str = "id", append: bool = False) -> int:
    """Write readings with their site ids as a table, and give its number of rows; raises if that isn't the readings'."""
    sinks.save_table(joins.site_ids(readings, lon, lat, key), table, append=append)
    spark = readings.sparkSession
    n, wanted = spark.table(table).count(), readings.count()
    if not append and n != wanted:
        raise DataError(f"{n} rows were written instead of {wanted}")
    return n


def import_items(items: DataFrame, current: DataFrame, prefix: str, *, append: bool = False, publish: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """A package's items into a catalog: hrefs below prefix, items of the same key replaced, then published.

    Appending adds only items whose key isn't there, and publishes nothing.
    """
    new = catalog.moved(items, prefix)
    if append:
        return catalog.add_missing(current, new, ["collection", "id"])
    whole = catalog.upsert(current, new)
    if publish is not None:
        publish(whole)
    return whole


def stream_metadata(rows: DataFrame, dataset: Column | str, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Metadata of a batch of messages: text_files.dataset_metadata by dataset, with defaults for a stream."""
    name = F.col(dataset) if isinstance(dataset, str) else dataset
    found = text_files.dataset_metadata(rows.withColumn("dataset_id", F.coalesce(name, F.lit("unknown_stream"))), "dataset_id")
    return with_defaults(found, {**DEFAULTS, "format": "stream", "mode": "streaming", **(defaults or {})})
