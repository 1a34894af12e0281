"""Sensor messages as a stream: parsing, quality control, dead letters, lateness."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.operators.quality import LIMITS

MESSAGE = "sensor_type string, timestamp string, pressure_kpa double, temperature_c double, platform string, message_id bigint"
#: Limits of the message's measurements.
MESSAGE_LIMITS = {"pressure_kpa": (0.0, 10_000.0), "temperature_c": LIMITS["temperature"]}


def source(spark: SparkSession, settings: Mapping[str, str]) -> DataFrame | None:
    """(value) of a stream: kind kafka, files or rate; None if the kind isn't configured.

    Kafka needs Spark's connector on the classpath. From the settings come topics, servers and, if given, group,
    offsets (where a new stream begins), poll (records a batch), data_loss ('fail', the default, or 'go on' where
    offsets are lost). Offsets are kept in the stream's checkpoint, so the broker's commits aren't used.
    """
    kind = settings.get("kind")
    if kind == "kafka":
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", settings["servers"]).option("subscribe", settings["topics"])
        if "group" in settings:
            reader = reader.option("kafka.group.id", settings["group"])
        if "poll" in settings:
            reader = reader.option("maxOffsetsPerTrigger", settings["poll"])
        reader = reader.option("startingOffsets", settings.get("offsets", "latest")).option("failOnDataLoss", str(settings.get("data_loss", "fail") == "fail").lower())
        return reader.load().select(F.col("value").cast("string").alias("value"))
    if kind == "files":
        return spark.readStream.schema("value string").option("maxFilesPerTrigger", settings.get("files", "100")).text(settings["path"])
    if kind == "rate":
        rows = spark.readStream.format("rate").option("rowsPerSecond", settings.get("rows", "10")).load()
        return rows.select(F.to_json(F.struct(F.lit("piezometer").alias("sensor_type"), F.col("timestamp").cast("string").alias("timestamp"), (F.col("value") % 100).cast("double").alias("pressure_kpa"))).alias("value"))
    return None


def parsed(raw: DataFrame) -> DataFrame:
    """raw (value) with the message's fields and dead: the text is no JSON object."""
    fields = F.from_json("value", f"{MESSAGE}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = raw.withColumn("_m", fields)
    dead = F.col("_m").isNull() | F.col("_m._broken").isNotNull() | ~F.coalesce(F.trim("value").startswith("{"), F.lit(False))
    return rows.withColumn("dead", dead).select("value", "dead", "_m.*").drop("_broken")


def checked(messages: DataFrame, limits: Mapping[str, tuple[float, float]] = MESSAGE_LIMITS) -> DataFrame:
    """messages with status: Fail for a value out of range, Warn if all values are missing, else Pass."""
    value = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in limits}
    bad = F.lit(False)
    for c, (low, high) in limits.items():
        bad = bad | F.coalesce(~value[c].between(low, high), F.lit(False))
    return messages.withColumns(value).withColumn("status", F.when(bad, "Fail").when(F.coalesce(*[F.col(c) for c in limits]).isNull(), "Warn").otherwise("Pass"))


def start_pipeline(raw: DataFrame, out: str, checkpoint: str, *, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Good messages to out/messages, failed and dead ones to out/rejected, counts by status to out/metrics.

    Each batch's folders are named by its number, so a batch that is run again replaces its own rows.
    """

    def save(batch: DataFrame, number: int) -> None:
        rows = checked(parsed(batch)).persist()
        try:
            status = F.when(F.col("dead"), "Dead").otherwise(F.col("status"))
            rows = rows.withColumn("status", status)
            for name, part in (("messages", rows.filter("status in ('Pass', 'Warn')")), ("rejected", rows.filter("status in ('Fail', 'Dead')")), ("metrics", rows.groupBy("status").count())):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            rows.unpersist()

    writer = raw.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def windowed(messages: DataFrame, late: str = "10 minutes", length: str = "5 minutes") -> DataFrame:
    """Extension: counts and means by sensor type and window of event time, late messages up to a limit."""
    when = F.col("timestamp").try_cast("timestamp")
    rows = messages.withColumn("event_time", when).filter("event_time is not null").withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", length).alias("w"), F.lower(F.trim("sensor_type")).alias("sensor_type")).agg(F.count(F.lit(1)).alias("n"), F.avg("pressure_kpa").alias("pressure_kpa")).select("w.start", "w.end", "sensor_type", "n", "pressure_kpa")


def once_each(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: messages delivered twice pass once, as long as they come within the limit."""
    rows = messages.withColumn("event_time", F.col("timestamp").try_cast("timestamp")).filter("event_time is not null")
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["message_id"])
