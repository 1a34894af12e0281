"""Append-only logs of tasks, and what can be asked of them."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of the log and their severity; the last three are task events.
LEVELS = {"debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50, "task_started": 101, "task_finished": 102, "task_failed": 103}


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(LEVELS.items(), 1)], "level_id int, level string, severity int")


def events_with_names(log: DataFrame, level: DataFrame, subsystem: DataFrame) -> DataFrame:
    """log with the names of level and subsystem; both tables are a fixed few rows."""
    return log.join(F.broadcast(level), "level_id", "left").join(F.broadcast(subsystem), "subsystem_id", "left")


def task_states(log: DataFrame) -> DataFrame:
    """(task_id, state, started, ended, seconds) from the events task_started, task_finished and task_failed.

    The last event counts, by time and then log id; a task without a start has no duration.
    """
    events = log.filter(F.col("level").startswith("task_"))
    rows = events.groupBy("task_id").agg(F.max_by(F.substring("level", 6, 20), F.struct("timestamp", "id")).alias("state"), F.min(F.when(F.col("level") == "task_started", F.col("timestamp"))).alias("started"), F.max(F.when(F.col("level") != "task_started", F.col("timestamp"))).alias("ended"))
    return rows.withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)


def latest(log: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The n rows with the highest key, highest first."""
    return log.orderBy(F.desc(key)).limit(n)


#: Subsystems that log, with their names.
SUBSYSTEMS = {
    "ALE": "Alert & Decision Support Engine", "DAG": "Data Aggregation", "DPR": "Data Processor", "EOU": "Earth Observation Data Uploader",
    "ISU": "In-Situ Data Uploader", "MAP": "Machine Learning & Predictive Analytics", "NTF": "Notifications", "QCL": "Quality Control and Logging Layer",
    "REP": "Reporting & Compliance", "SDI": "Spatial Data Infrastructure", "VID": "Visualisation & Dashboard",
}
LOG = "id string, timestamp timestamp, level string, task_id string, message string, subsystem string, site string, project string"


def subsystems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SUBSYSTEMS.items()), "subsystem_id string, subsystem string")


def seeded(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A dimension: table as it is, or rows if it is empty."""
    return table if table.limit(1).count() else rows


def task_events(runs: DataFrame) -> DataFrame:
    """Append-only log rows (id, timestamp, level, task_id) of runs (task_id, started, ended, ok).

    A run without a start is none; one without an end is still going on; a null ok is a failure. A start comes
    before an end of the same time by id.
    """
    ended = F.when(F.col("ended").isNotNull(), F.struct(F.lit(2).alias("n"), F.col("ended").alias("timestamp"), F.when(F.coalesce("ok", F.lit(False)), "task_finished").otherwise("task_failed").alias("level")))
    begun = F.struct(F.lit(1).alias("n"), F.col("started").alias("timestamp"), F.lit("task_started").alias("level"))
    rows = runs.filter("task_id is not null and started is not null").select("task_id", F.explode(F.array_compact(F.array(begun, ended))).alias("_e"))
    return rows.select(F.concat_ws("/", "task_id", "_e.n").alias("id"), "_e.timestamp", "_e.level", "task_id")


class TaskLog:
    """Writes one subsystem's log rows, with site and project, to an append-only table of the schema LOG.

    Rows are kept until flush(), which a task's end and leaving the log as a context call. One task is active
    at a time: a new one takes the place of the last; rows logged in it have its id.
    """

    def __init__(self, spark: SparkSession, path: str, subsystem: str, site: str | None = None, project: str | None = None, clock: Callable[[], dt.datetime] | None = None):
        if subsystem not in SUBSYSTEMS:
            raise ValueError(f"unknown subsystem {subsystem}")
        self.spark, self.path, self.context = spark, path, (subsystem, site, project)
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.task_id: str | None = None
        self.rows: list[tuple] = []
        self.n = 0
        self.key = uuid.uuid4().hex

    def log(self, level: str, message: str, task_id: str | None = None) -> None:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level}")
        self.n += 1
        self.rows.append((f"{self.key}/{self.n:09d}", self.clock(), level, task_id or self.task_id, message, *self.context))

    def task_started(self, name: str) -> str:
        self.task_id = uuid.uuid4().hex
        self.log("task_started", f"{name} started")
        return self.task_id

    def _ended(self, level: str, name: str, task_id: str | None) -> None:
        own = task_id or self.task_id
        if own is None:
            raise ValueError("no task is active")
        self.log(level, f"{name} {level[5:]}", own)
        if own == self.task_id:
            self.task_id = None
        self.flush()

    def task_finished(self, name: str, task_id: str | None = None) -> None:
        self._ended("task_finished", name, task_id)

    def task_failed(self, name: str, task_id: str | None = None) -> None:
        self._ended("task_failed", name, task_id)

    @contextmanager
    def task(self, name: str) -> Iterator[str]:
        """A block as a task: finished, or failed if it raises, which goes on."""
        task_id = self.task_started(name)
        try:
            yield task_id
        except BaseException:
            self.task_failed(name, task_id)
            raise
        self.task_finished(name, task_id)

    def flush(self) -> None:
        if self.rows:
            self.spark.createDataFrame(self.rows, LOG).coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []

    def __enter__(self) -> TaskLog:
        return self

    def __exit__(self, *_) -> None:
        self.flush()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)
