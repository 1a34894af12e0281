"""Irregular readings onto a regular grid with its missing periods marked.

Each source's time line is cut into shards of a fixed number of slots. A shard finds its own gaps and
keeps only its first and last filled slot; a scan over these summaries carries the last filled slot to the
next shard, which gives the gaps that span shards. Gaps are then filled shard by shard, wherever they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.session import cut

#: Readings dated before 2000 come from clocks that were reset.
OLDEST = "2000-01-01T00:00:00Z"


def utc_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO text; without a zone it is UTC; null if it is no instant."""
    t = F.trim(text)
    zoned = t.rlike(r"[Zz]$|[+-]\d\d(:?\d\d)?$") & t.contains(":")
    return F.unix_micros(F.when(zoned, t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp"))


def _filled(messages: DataFrame, kinds: DataFrame, shard_slots: int) -> DataFrame:
    """(source, period, typed, slot, shard) of each message that fills a slot.

    A message without a type is tried with every period; those of other types than its source's fall away
    in _own_period(). The kinds are one row for each sensor type and broadcast.
    """
    values = [F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("pressure_kpa", "temperature_c")]
    rows = messages.select(F.col("platform").alias("source"), F.lower(F.trim("sensor_type")).alias("_kind"), utc_micros(F.col("timestamp")).alias("us"), F.coalesce(*values).alias("_value"))
    oldest = F.unix_micros(F.lit(OLDEST).cast("timestamp"))
    rows = rows.filter(F.col("source").isNotNull() & F.col("_value").isNotNull() & (F.col("us") >= oldest))
    known = kinds.select(F.lower(F.trim("sensor_type")).alias("_k"), F.col("period_s").cast("bigint").alias("period")).filter("period > 0 and _k is not null").distinct()
    known = known.agg(F.collect_list(F.struct("_k", "period")).alias("_known"))
    rows = rows.crossJoin(F.broadcast(known))  # one row: the fixed list of sensor types
    own = F.filter("_known", lambda k: k._k == F.col("_kind"))
    rows = rows.withColumn("typed", F.coalesce(F.size(own) > 0, F.lit(False)))
    rows = rows.select("source", "us", "typed", F.explode(F.when(F.col("typed"), own).otherwise(F.col("_known")).period).alias("period"))
    length = F.col("period") * 1_000_000
    slot = ((F.col("us") - F.pmod(F.col("us"), length)) / length).cast("bigint")
    return rows.select("source", "period", "typed", slot.alias("slot"), F.floor(slot / shard_slots).alias("shard"))


def missing_slots(messages: DataFrame, kinds: DataFrame, shard_slots: int = 4096) -> DataFrame:
    """Slots strictly between a source's first and last filled slots that aren't filled: (source, period, slot).

    messages: platform, sensor_type, timestamp (text, UTC), pressure_kpa, temperature_c; other columns are
    ignored. kinds: sensor_type, period_s. A slot is filled by a message with a pressure or a temperature
    (NaN is none), dated 2000 or later. A source has the period of its sensor type, case and outer spaces
    apart; if it names several, that of most messages counts, the shortest on a tie. Sources that never name
    a known type, null sources and texts that are no time have no slots. Repeated rows change nothing; an
    empty table gives an empty result.
    """
    # aggregated before it is sent by shard, so that a shard gets a row for each slot, however many messages fill it
    filled = _filled(messages, kinds, shard_slots).groupBy("source", "period", "shard", "slot").agg(F.count_if("typed").alias("typed"))
    w = Window.partitionBy("source", "period", "shard").orderBy("slot")
    edges = filled.withColumns({"_back": F.lag("slot").over(w), "_next": F.lead("slot").over(w), "_typed": F.sum("typed").over(Window.partitionBy("source", "period", "shard"))})
    edges = edges.filter("_back is null or _next is null or slot - _back > 1")
    # of a shard's rows only its ends and gaps are left; both uses below read them from the shared folder
    edges = cut(edges.select("source", "period", "shard", "slot", "_back", F.col("_next").isNull().alias("_last"), "_typed"))

    own = edges.filter("_last").groupBy("source", "period").agg(F.sum("_typed").alias("_n"))
    own = own.filter("_n > 0").groupBy("source").agg(F.max_by("period", F.struct("_n", -F.col("period"))).alias("period"))

    # a source has one summary for each shard of its time line that holds a reading
    shards = edges.groupBy("source", "period", "shard").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
    carry = F.lag("last").over(Window.partitionBy("source", "period").orderBy("shard"))
    between = shards.select("source", "period", (carry + 1).alias("lo"), (F.col("first") - 1).alias("hi"))
    inside = edges.select("source", "period", (F.col("_back") + 1).alias("lo"), (F.col("slot") - 1).alias("hi"))
    gaps = between.unionByName(inside).filter("lo <= hi").join(own, ["source", "period"], "left_semi")
    # first the shards of a gap, spread over the cluster, then the slots of each: no long gap in one task
    part = F.explode(F.sequence(F.floor(F.col("lo") / shard_slots), F.floor(F.col("hi") / shard_slots)))
    long = F.floor(F.col("lo") / shard_slots) < F.floor(F.col("hi") / shard_slots)
    pieces = gaps.filter(long).withColumn("shard", part).repartition("source", "shard")
    pieces = pieces.withColumns({"lo": F.greatest("lo", F.col("shard") * shard_slots), "hi": F.least("hi", (F.col("shard") + 1) * shard_slots - 1)})
    pieces = pieces.drop("shard").unionByName(gaps.filter(~long))
    return pieces.select("source", "period", F.explode(F.sequence("lo", "hi")).alias("slot"))


def regular_series(messages: DataFrame, kinds: DataFrame, shard_slots: int = 4096) -> DataFrame:
    """Every slot of each source from its first to its last filled one: (source, slot_start_us, missing,
    n_messages, pressure_kpa, temperature_c), values averaged over the slot's distinct messages.

    Rules and rare cases as in missing_slots(); a missing slot has 0 messages and null values.
    """
    values = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("pressure_kpa", "temperature_c")}
    rows = messages.select("message_id", F.col("platform").alias("source"), F.lower(F.trim("sensor_type")).alias("_kind"), utc_micros(F.col("timestamp")).alias("us"), *[v.alias(c) for c, v in values.items()])
    rows = rows.filter(F.col("source").isNotNull() & F.coalesce(*[F.col(c) for c in values]).isNotNull() & (F.col("us") >= F.unix_micros(F.lit(OLDEST).cast("timestamp")))).distinct()
    known = kinds.select(F.lower(F.trim("sensor_type")).alias("_kind"), F.col("period_s").cast("bigint").alias("period")).filter("period > 0 and _kind is not null").distinct()
    votes = rows.join(F.broadcast(known), "_kind").groupBy("source", "period").agg(F.count(F.lit(1)).alias("_n"))
    own = votes.groupBy("source").agg(F.max_by("period", F.struct("_n", -F.col("period"))).alias("period"))
    salts = 16
    salted = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("us"), F.lit(salts)).cast("int")).join(salted, ["source", "_salt"])
    start = F.col("us") - F.pmod(F.col("us"), F.col("period") * 1_000_000)
    there = rows.groupBy("source", start.alias("slot_start_us")).agg(F.count(F.lit(1)).alias("n_messages"), *[F.avg(c).alias(c) for c in values]).withColumn("missing", F.lit(False))
    gone = missing_slots(messages, kinds, shard_slots).select("source", (F.col("slot") * F.col("period") * 1_000_000).alias("slot_start_us"), F.lit(0).cast("bigint").alias("n_messages"), *[F.lit(None).cast("double").alias(c) for c in values], F.lit(True).alias("missing"))
    return there.unionByName(gone)
