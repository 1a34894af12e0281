"""Sinks: tables, packages, manifests and exports."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import tempfile
import zipfile
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A table name whose parts are quoted identifiers."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def save_table(df: DataFrame, name: str, *, append: bool = False, buckets: int = 0, by: str | None = None) -> None:
    """Write a table, in place of the old one or after its rows, perhaps bucketed for later joins."""
    writer = df.write.mode("append" if append else "overwrite").format("parquet")
    if buckets and by:
        writer = writer.bucketBy(buckets, by).sortBy(by)
    writer.saveAsTable(quoted(name))


def save_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just those partitions that df has rows of, each whole or not at all."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def strict_json(value: Any) -> Any:
    """value with NaN and infinities as null, for JSON."""
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, Mapping):
        return {k: strict_json(v) for k, v in value.items()}
    return [strict_json(v) for v in value] if isinstance(value, list | tuple) else value


def save_manifest(path: str, content: Mapping[str, Any]) -> None:
    """Write a small JSON file whole or not at all; path is one of the driver's machine or a URI."""
    text = json.dumps(strict_json(dict(content)), indent=2, default=str, allow_nan=False)
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        system.create_dir(at.rsplit("/", 1)[0])
        with system.open_output_stream(f"{at}.part") as out:
            out.write(text.encode())
        system.move(f"{at}.part", at)
        return
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as out:
        out.write(text)
    os.replace(out.name, path)


def save_stage(df: DataFrame, path: str, keys: list[str], manifest: Mapping[str, Any]) -> None:
    """A stage's rows and a manifest with their count; keys must be distinct. The manifest comes last."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("keys repeat")
    df.write.mode("overwrite").parquet(f"{path}/rows")
    save_manifest(f"{path}/manifest.json", {**manifest, "rows": df.sparkSession.read.parquet(f"{path}/rows").count(), "complete": True})


def _text(path: str) -> str:
    if "://" in path:
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        with system.open_input_stream(at) as file:
            return file.read().decode()
    with open(path) as file:
        return file.read()


def save_rasters(df: DataFrame, path: str, product: str, units: str, *, by: str = "date", tags: Mapping[str, str] | None = None) -> None:
    """Cells (by, row, col, value, ...) of a product by date or pair: path/product=.../<by>=..., units and tags as columns.

    Only the dates or pairs that df has are replaced. Writing a picture of them is left to a reader of the table.
    """
    rows = df.withColumns({"product": F.lit(product), "units": F.lit(units), **{f"tag_{k}": F.lit(v) for k, v in (tags or {}).items()}})
    save_partitions(rows, path, ["product", by])


def save_diagnostics(df: DataFrame, path: str) -> None:
    """A table as CSV and as JSON lines without NaN: path/csv and path/json."""
    kinds = dict(df.dtypes)
    save_csv(df, f"{path}/csv")
    whole = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in df.columns if kinds[c] in ("double", "float")})
    whole.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")


def run_summary(folder: str, started: dt.datetime, stages: Mapping[str, str], versions: Mapping[str, str], failure: BaseException | None = None) -> str:
    """Write a run's summary to a folder named by its start, and give its path: versions, state of each stage, kind of failure."""
    path = f"{folder.rstrip('/')}/{started:%Y%m%dT%H%M%S%f}/summary.json"
    state = "failed" if failure else "finished"
    save_manifest(path, {"started": started.isoformat(), "state": state, "stages": dict(stages), "versions": dict(versions), "failure": type(failure).__name__ if failure else None})
    return path


def open_stage(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a complete stage, else None."""
    try:
        complete = json.loads(_text(f"{path}/manifest.json")).get("complete")
    except OSError:
        return None
    return spark.read.parquet(f"{path}/rows") if complete else None


def package(out: str, files: Mapping[str, str], item: Mapping[str, Any]) -> None:
    """A ZIP of files (name -> path) and the item's JSON."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, path in files.items():
            archive.write(path, name)
        archive.writestr("item.json", json.dumps(strict_json(dict(item))))


def open_package(path: str, folder: str) -> tuple[dict[str, Any], list[str]]:
    """(item, files) of a ZIP extracted to folder; the last JSON counts, none is an error."""
    with zipfile.ZipFile(path) as archive:
        for member in archive.namelist():
            if os.path.isabs(member) or ".." in member.split("/"):
                raise ValueError("the package reaches outside its folder")
        archive.extractall(folder)
        names = archive.namelist()
    items = [n for n in names if n.endswith(".json")]
    if not items:
        raise ValueError("the package has no item")
    with open(os.path.join(folder, items[-1])) as found:
        return json.load(found), [os.path.join(folder, n) for n in names if n not in items and not n.endswith("/")]


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
