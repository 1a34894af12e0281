"""Quality control as a service: route datasets to controllers, keep lineage, raise alerts, hand results on, review by hand.

Controllers work on whole tables and give one row for each dataset, so a run over many datasets is one plan.
Results are (dataset_id, status, errors, actions, metrics).
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators import quality
from gaugeflow.sources.settings import SettingsError

LOG = logging.getLogger("gaugeflow.qc")
Controller = Callable[..., DataFrame]
Service = Callable[[DataFrame], None]
#: What may be done by hand, and the status of a dataset whose checks run again.
REVIEWS, PENDING = ("inspect", "override", "re-run"), "Pending"


def _told(tests: Mapping[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(t, F.lit(m)) for m, t in tests.items()]))


def in_situ(df: DataFrame, dataset: str, **options) -> DataFrame:
    """Results of `quality.check_readings`, whose options these are."""
    found = quality.check_readings(df, dataset, **options)
    counts = {"duplicates": "repeated keys", "fault_rows": "sensor faults", "range_rows": "values out of range", "missing_rows": "missing values", "office_rows": "office rows"}
    errors = _told({m: F.col(c) > 0 for c, m in counts.items()})
    metrics = F.map_from_arrays(F.array(*map(F.lit, ["n_rows", *counts, "missing_fraction"])), F.array(*[F.col(c).cast("double") for c in ["n_rows", *counts, "missing_fraction"]]))
    return found.select(F.col(dataset).cast("string").alias("dataset_id"), "status", errors.alias("errors"), F.array(*map(F.lit, ("keys", "flags", "ranges", "missing"))).alias("actions"), metrics.alias("metrics"))


def raster(scenes: DataFrame, dataset: str, **options) -> DataFrame:
    """Results of `quality.check_scenes`; of repeated scenes the worst counts."""
    found = quality.check_scenes(scenes, **options)
    metrics = F.map_from_arrays(F.array(F.lit("null_pixel_pct"), F.lit("snr")), F.array(F.max(F.col("null_pixel_pct").cast("double")), F.min(F.col("snr").cast("double"))))
    rows = found.groupBy(F.col(dataset).cast("string").alias("dataset_id"))
    return rows.agg(quality.worst(F.col("status")).alias("status"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("errors")))).alias("errors"), F.array(*map(F.lit, ("nulls", "alignment", "metadata", "noise"))).alias("actions"), metrics.alias("metrics"))


CONTROLLERS: dict[str, Controller] = {"in_situ": in_situ, "eo_raster": raster}


def route(data_type: str, controllers: Mapping[str, Controller] = CONTROLLERS) -> Controller:
    """The controller of a type of data; an unknown type is an error of the settings."""
    if data_type not in controllers:
        raise SettingsError(f"no controller for {data_type}; there are {sorted(controllers)}")
    return controllers[data_type]


def lineage(results: DataFrame, when: Column) -> DataFrame:
    """(timestamp, dataset_id, actions, status): what was done to each dataset."""
    return results.select(when.alias("timestamp"), "dataset_id", "actions", "status")


def alerts(results: DataFrame) -> DataFrame:
    """(dataset_id, errors) of datasets that failed."""
    return results.filter("status = 'Fail'").select("dataset_id", "errors")


#: Services and the results that each is given: a catalog and a dashboard all, notifications failures and warnings.
WANTED = {"catalog": None, "notification": "status in ('Fail', 'Warn')", "dashboard": None}


def dispatch(results: DataFrame, services: Mapping[str, Service | None]) -> list[str]:
    """Hand results to the services; one that isn't there is passed over with a warning. Gives the names of those served."""
    served = []
    for name, wanted in WANTED.items():
        if (service := services.get(name)) is None:
            LOG.warning("no %s service; results are not handed on", name)
            continue
        service(results.filter(wanted) if wanted else results)
        served.append(name)
    return served


def append_to(path: str) -> Service:
    """A service that appends what it is given to a table."""
    return lambda rows: rows.write.mode("append").parquet(path)


def process(data_type: str, data: DataFrame, dataset: str, *, folder: str, when: Column | None = None, services: Mapping[str, Service | None] | None = None, **options) -> DataFrame:
    """Check all datasets of a table and give the results; lineage is appended to folder/lineage, alerts to folder/alerts.

    Results are written first and read back, so that services and the caller see what was logged.
    """
    spark = data.sparkSession
    run = spark.sql("select uuid()").first()[0]
    path = f"{folder}/results/run={run}"
    route(data_type)(data, dataset, **options).write.parquet(path)
    results = spark.read.parquet(path)
    append_to(f"{folder}/lineage")(lineage(results, F.current_timestamp() if when is None else when))
    append_to(f"{folder}/alerts")(alerts(results))
    dispatch(results, services or {})
    return results


def review(spark: SparkSession, folder: str, dataset_id: str, action: str, new_status: str | None = None) -> DataFrame:
    """Inspect, override or re-run a dataset by hand: its lineage, newest first. Overrides and re-runs add to it."""
    if action not in REVIEWS or (action == "override" and not new_status):
        raise SettingsError(f"a review is one of {REVIEWS}, an override has a new status")
    if action != "inspect":
        done, status = (f"manual override to {new_status}", new_status) if action == "override" else ("manual re-run", PENDING)
        row = spark.createDataFrame([(dataset_id, [done], status)], "dataset_id string, actions array<string>, status string")
        append_to(f"{folder}/lineage")(lineage(row, F.current_timestamp()))
    return spark.read.parquet(f"{folder}/lineage").filter(F.col("dataset_id") == dataset_id).orderBy(F.desc("timestamp"))


def current_status(records: DataFrame) -> DataFrame:
    """(dataset_id, status) of the newest lineage record of each dataset; of equal times the last status by name."""
    return records.groupBy("dataset_id").agg(F.max_by("status", F.struct("timestamp", "status")).alias("status"))
