"""Implausible readings: values out of range, frozen runs, and short spikes off a source's own level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.shards import rank_blocks, thinned_blocks
from gaugeflow.session import cut

#: Quartile distance of a normal distribution in standard deviations.
_QUARTILES = 1.349
_SALTS = 16


def _median(values: list[Column]) -> Column:
    """Median of those columns that aren't null; null if all are."""
    s = F.sort_array(F.array(*values))  # nulls first
    nulls = sum((v.isNull().cast("int") for v in values[1:]), values[0].isNull().cast("int"))
    low = nulls + F.floor((len(values) - nulls - 1) / 2).cast("int")
    high = nulls + F.floor((len(values) - nulls) / 2).cast("int")
    return F.when(nulls < len(values), (F.get(s, low) + F.get(s, high)) / 2)


def _frozen(rows: DataFrame, run: int, block_rows: int) -> DataFrame:
    """Distinct rows in blocks with frozen: the reading is one of at least run equal ones in a row."""
    blocks = rank_blocks(rows, ["_src", "_t", "_key"], block_rows, halo=run - 1, distinct=True).repartition("block")
    w = Window.partitionBy("block", "_src").orderBy("pos")
    # equal readings in a row have one number
    other = F.coalesce(F.lag("_v").over(w) != F.col("_v"), F.lit(True)).cast("int")
    runs = blocks.withColumn("_other", other).withColumn("_run", F.sum("_other").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_other")
    size = F.count(F.lit(1)).over(Window.partitionBy("block", "_src", "_run"))
    return runs.withColumn("frozen", size >= run).drop("_run")


def flag_spikes(
    df: DataFrame,
    *,
    source: str,
    when: str,
    key: str,
    value: str,
    low: float,
    high: float,
    run: int = 8,
    longest: int = 3,
    reach: int = 7,
    factor: float = 8.0,
    resolution: float = 0.01,
    fence: float | None = None,
    block_rows: int = 16384,
) -> DataFrame:
    """Implausible readings as (source, key, value, reason, level, scatter), each row once.

    reason is 'range' (outside low..high), 'frozen' (one of at least run equal readings in a row) or
    'spike' (one of at most longest readings in a row that stand off by factor times the source's scatter
    from the level of the reach readings before and of those after). A level that changes for good is none.
    Where fence is given there are two more, for readings without another reason: 'fence' (the distance to the
    level around it lies more than fence quartile distances outside the source's quartiles) and 'rate' (the
    change a day since the reading before lies so far above the quartiles of the source's changes).

    Quartiles come from approximate quantile sketches by source and hour of day (one hour for dates) that are
    merged over partitions; the scatter of a source is the quartile distance of its readings about their levels.
    Rows of range and frozen are set aside before levels and sketches.

    Nulls: a null or NaN value is no reading; a null source is a source of its own; a null time sorts
    first. Ties in time go by key. Exact repeats of (source, time, key, value) count once. An empty table
    gives an empty result. Other columns of df, whatever their names, are ignored.
    """
    hourly = dict(df.dtypes)[when].startswith("timestamp")
    number = F.col(value).cast("double")
    rows = df.select(F.col(source).alias("_src"), F.col(when).alias("_t"), F.col(key).alias("_key"), number.alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    blocks = _frozen(rows, run, block_rows)
    reason = F.when(~F.col("_v").between(low, high), "range").when(F.col("frozen"), "frozen")
    names = ["_src", "_t", "_key", "_v", "reason"]
    checked, blocks = thinned_blocks(blocks.withColumn("reason", reason), F.col("reason").isNull(), names, block_rows, halo=reach + longest + 2)
    hard = checked.filter("reason is not null").withColumns({"level": F.lit(None).cast("double"), "scatter": F.lit(None).cast("double")})
    blocks = blocks.drop("reason")
    w = Window.partitionBy("block", "_src").orderBy("pos")
    near = {f"_p{i}": F.lag("_v", i).over(w) for i in range(1, reach + 1)} | {f"_n{i}": F.lead("_v", i).over(w) for i in range(1, reach + 1)}
    if fence is not None:
        near["_t_before"] = F.lag("_t").over(w)
    blocks = blocks.withColumns(near)
    past, coming = ([F.col(f"_{side}{i}") for i in range(1, reach + 1)] for side in "pn")
    blocks = blocks.withColumns({"_before": _median(past), "_after": _median(coming), "level": _median(past + coming)})
    blocks = blocks.withColumns({f"_b{j}": F.lag("_before", j).over(w) for j in range(1, longest)} | {f"_a{j}": F.lead("_after", j).over(w) for j in range(1, longest)})

    def at(step: int) -> Column:
        return F.col("_v" if step == 0 else f"_p{-step}" if step < 0 else f"_n{step}")

    spans = []
    for length in range(1, longest + 1):
        for j in range(length):  # this row is number j of the run
            before, after = F.col(f"_b{j}" if j else "_before"), F.col(f"_a{length - 1 - j}" if length - 1 - j else "_after")
            off = F.least(*[F.abs(at(i) - side) for i in range(-j, length - j) for side in (before, after)])
            calm = F.greatest(F.abs(at(-j - 1) - before), F.abs(at(length - j) - after))
            known = before.isNotNull() & after.isNotNull()
            # no scatter is below half the resolution, so smaller distances are no spike
            spans.append(F.when(known & (calm < off) & (off >= factor * resolution / 2), F.struct(calm.alias("calm"), off.alias("off"))))
    blocks = blocks.filter("core").withColumn("_spans", F.array_compact(F.array(*spans)))
    blocks = blocks.withColumn("_hour", F.hour("_t") if hourly else F.lit(0))
    # written once: the sketches and the candidates both need the levels
    times = [] if fence is None else ["_t", "_t_before", "_p1"]
    blocks = cut(blocks.select("_src", "_hour", "_key", "_v", "level", "_spans", "pos", *times))

    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), F.lit(4000))
    measures = {"_q": F.col("_v") - F.col("level")}
    if fence is not None:
        days = (F.unix_micros(F.col("_t").cast("timestamp")) - F.unix_micros(F.col("_t_before").cast("timestamp"))) / 86_400_000_000
        measures["_rq"] = F.abs(F.col("_v") - F.col("_p1")) / F.nullif(days, F.lit(0.0))
    sketch = blocks.groupBy("_src", "_hour").agg(*[quartiles(m).alias(n) for n, m in measures.items()])
    scatter = F.greatest((F.col("_q")[1] - F.col("_q")[0]) / _QUARTILES, F.lit(resolution / 2)).alias("scatter")
    sketch = sketch.select("_src", "_hour", scatter, *measures, F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("_salt"))
    asked = F.size("_spans") > 0 if fence is None else F.lit(True)
    extra = [] if fence is None else [measures["_rq"].alias("_rate")]
    maybe = blocks.filter(asked).select("_src", "_hour", "_key", "_v", "level", "_spans", *extra, F.pmod(F.col("pos"), F.lit(_SALTS)).cast("int").alias("_salt"))
    joined = maybe.join(sketch, (maybe._salt == sketch._salt) & (maybe._hour == sketch._hour) & maybe._src.eqNullSafe(sketch._src)).select(maybe["*"], "scatter", *measures)
    limit = F.col("scatter") * factor
    reason = F.when(F.exists("_spans", lambda s: (s.calm < limit) & (s.off >= limit)), "spike")
    if fence is not None:

        def beyond(value: Column, q: str) -> Column:
            width = F.greatest(F.col(q)[1] - F.col(q)[0], F.lit(resolution)) * fence
            return (value < F.col(q)[0] - width) | (value > F.col(q)[1] + width)

        reason = reason.when(beyond(F.col("_v") - F.col("level"), "_q"), "fence").when(beyond(F.col("_rate"), "_rq"), "rate")
    out = ["_src", "_key", "_v", "reason", "level", "scatter"]
    found = hard.select(out).unionByName(joined.withColumn("reason", reason).filter("reason is not null").select(out))
    return found.toDF("source", "key", "value", "reason", "level", "scatter")
