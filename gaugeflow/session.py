"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: What the engine expects of a session. Everything else is left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. On a cluster, pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("gaugeflow")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's Python workers, once; they need not have it installed."""
    context = spark.sparkContext
    if "gaugeflow.zip" not in context._python_includes:
        package = os.path.dirname(os.path.abspath(__file__))
        # staged on the driver only: Spark's file server hands it to the executors
        path = os.path.join(tempfile.mkdtemp(prefix="gaugeflow-"), "gaugeflow.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        archive.write(file, os.path.join("gaugeflow", os.path.relpath(file, package)))
        context.addPyFile(path)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only a local session (tests, a laptop) without one gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gaugeflow-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: lost executors can't undo it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
