"""Features for models: scaling, imputing, clipping, encoding, and ordered tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.shards import along


def _joined(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df with the statistics of its group; without keys these are one row. Null keys have statistics too."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    on = [df[k].eqNullSafe(stats[k]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return df.join(stats, condition).drop(*[stats[k] for k in keys])


def z_scored(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with <value>_z in population standard deviations; null where these are 0."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    return _joined(df, stats, keys).withColumn(f"{value}_z", (F.col(value) - F.col("_mean")) / F.nullif(F.col("_dev"), F.lit(0.0))).drop("_mean", "_dev")


def scaled(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with <value>_scaled from 0 at the least to 1 at the largest; null where they are equal."""
    stats = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return _joined(df, stats, keys).withColumn(f"{value}_scaled", (F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0))).drop("_low", "_high")


def imputed(df: DataFrame, value: str, how: str = "median", keys: Sequence[str] = (), most_missing: float = 1.0) -> DataFrame:
    """df with nulls of value replaced by the group's mean or median, or their rows dropped.

    A group with a share of nulls above most_missing is left as it is.
    """
    if how == "drop":
        return df.filter(F.col(value).isNotNull())
    fill = (F.median if how == "median" else F.avg)(value)
    stats = df.groupBy(*keys).agg(fill.alias("_fill"), F.avg(F.col(value).isNull().cast("int")).alias("_share"))
    fitting = F.when(F.col("_share") <= most_missing, F.col("_fill"))
    return _joined(df, stats, keys).withColumn(value, F.coalesce(value, fitting)).drop("_fill", "_share")


def clipped(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, keys: Sequence[str] = ()) -> DataFrame:
    """df with <value>_clipped between two exact quantiles of its group."""
    stats = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("_q"))
    inside = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_q")[0]), F.col("_q")[1]))
    return _joined(df, stats, keys).withColumn(f"{value}_clipped", inside).drop("_q")


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{column}_{c}": (F.coalesce(F.col(column) == c, F.lit(False))).cast("int") for c in categories})


def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with name: categories numbered from 0 by frequency, then by name; null stays null."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    # one row for each category
    codes = counts.withColumn(name, F.row_number().over(Window.orderBy(F.desc("count"), column)) - 1).drop("count")
    return df.join(codes, column, "left")


def tensor(df: DataFrame, keys: Sequence[str], order: str, features: Sequence[str]) -> DataFrame:
    """(keys, tensor): the features of each key as one array for each step in time, in order."""
    step = F.struct(F.col(order), F.array(*[F.col(f).cast("double") for f in features]).alias("_f"))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(step)), lambda s: s["_f"]).alias("tensor"))


def gaps(df: DataFrame, keys: Sequence[str], when: str, value: str, most_missing: float = 0.3, longest_days: float = 60.0) -> DataFrame:
    """(keys, missing_fraction, longest_gap_days, valid) of each series."""
    rows = df.withColumn("_us", F.unix_micros(F.col(when).cast("timestamp")))
    rows = along(rows, keys, ["_us"], lambda c, w: {"_gap": (c("_us") - F.lag(c("_us")).over(w)) / 86_400_000_000})
    out = rows.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("int")).alias("missing_fraction"), F.coalesce(F.max("_gap"), F.lit(0.0)).alias("longest_gap_days"))
    return out.withColumn("valid", (F.col("missing_fraction") <= most_missing) & (F.col("longest_gap_days") <= longest_days))


def log_scaled(value: Column) -> Column:
    return F.when(value > -1, F.log1p(value))
