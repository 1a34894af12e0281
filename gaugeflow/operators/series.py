"""Time-series operators: rolling sums, differences, resampling, alignment.

A series may hold much of the data: operators that look at neighbours, or for the last and next known value, work
in blocks of rows (see `shards`). Only rolling() and climate_features() take a window over a whole series, of one
row a day and location; rolling_blocks() has no such bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.shards import along, carried, rank_blocks


def rolling(value: Column, rows: int, keys: Sequence[str], order: Sequence[str], how: str = "sum") -> Column:
    """Sum, mean or count of value over this and the rows - 1 rows before it; nulls are left out."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    return {"sum": F.sum, "mean": F.avg, "count": F.count}[how](value).over(frame)


def rolling_blocks(df: DataFrame, value: str, rows: int, keys: Sequence[str], order: Sequence[str], name: str, block_rows: int = 65536) -> DataFrame:
    """df with name: the rolling sum of value, for series of any size; the key and order columns are those of df."""
    blocks = rank_blocks(df, [*keys, *order], block_rows, halo=rows - 1)
    frame = Window.partitionBy("block", *keys).orderBy("pos").rowsBetween(1 - rows, 0)
    return blocks.withColumn(name, F.sum(value).over(frame)).filter("core").select(*df.columns, name)


def climate_features(daily: DataFrame, location: str = "location") -> DataFrame:
    """Daily weather with its rolling features: date, precipitation_sum, et0, temperature_max, wind_gust.

    A day is wet above 1 mm; a missing value counts as dry and is left out of sums and means.
    """
    keys, order = [location], ["date"]
    wet = F.when(F.col("precipitation_sum") > 1.0, 1).otherwise(0)
    balance = F.col("precipitation_sum") - F.col("et0")
    return daily.withColumns(
        {
            "precip_7d_mm": rolling(F.col("precipitation_sum"), 7, keys, order),
            "precip_30d_mm": rolling(F.col("precipitation_sum"), 30, keys, order),
            "wet_days_30d": rolling(wet, 30, keys, order),
            "water_balance_30d_mm": rolling(balance, 30, keys, order),
            "temp_max_month_anom": F.col("temperature_max") - rolling(F.col("temperature_max"), 30, keys, order, "mean"),
        }
    )


def steps(df: DataFrame, value: str, keys: Sequence[str], date: str) -> DataFrame:
    """df with step (0 at the first date and beside nulls), days (at least 1) and velocity = |step| / days."""

    def columns(c, w) -> dict[str, Column]:
        gap = F.datediff(c(date), F.lag(c(date)).over(w))
        return {"step": F.coalesce(c(value) - F.lag(c(value)).over(w), F.lit(0.0)), "days": F.when(gap > 0, gap).otherwise(1)}

    return along(df, keys, [date], columns).withColumn("velocity", F.abs(F.col("step") / F.col("days")))


def accelerations(df: DataFrame, value: str, keys: Sequence[str], date: str) -> DataFrame:
    """df with rate and acceleration: the change a day since the row before, and the change of that a day.

    Three rows make one acceleration; before that, beside nulls and between equal times both are null.
    """

    def columns(c, w) -> dict[str, Column]:
        days = lambda n: F.nullif(F.datediff(F.lag(c(date), n).over(w), F.lag(c(date), n + 1).over(w)).cast("double"), F.lit(0.0))
        rate = [(F.lag(c(value), n).over(w) - F.lag(c(value), n + 1).over(w)) / days(n) for n in (0, 1)]
        return {"rate": rate[0], "acceleration": (rate[0] - rate[1]) / days(0)}

    return along(df, keys, [date], columns, reach=2)


def from_first(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """df with name: value less that of the first row of its series, found by one aggregate; the join splits crowded series."""
    first = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(F.struct(F.col(value).alias("v")), order).alias("_first"))
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(first[f"_{k}"])
    return df.join(first, same).withColumn(name, F.col(value) - F.col("_first.v")).drop("_first", *[f"_{k}" for k in keys])


def intervals(df: DataFrame, value: str, keys: Sequence[str], when: str) -> DataFrame:
    """Consecutive pairs of a series: (keys, start, end, change, rate a day); null unless both ends are known."""

    def columns(c, w) -> dict[str, Column]:
        seconds = F.unix_micros(c(when).cast("timestamp")).cast("double") / 1e6
        return {"start": F.lag(c(when)).over(w), "_old": F.lag(c(value)).over(w), "_days": (seconds - F.lag(seconds).over(w)) / 86400}

    rows = along(df, keys, [when], columns)
    change = F.col(value) - F.col("_old")
    return rows.filter("start is not null").select(*keys, "start", F.col(when).alias("end"), change.alias("change"), (change / F.nullif(F.col("_days"), F.lit(0.0))).alias("rate"))


def last_steps(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, last, last_step): the last value of a series and its difference to the one before."""
    rows = along(df, keys, [order], lambda c, w: {"_before": F.lag(c(value)).over(w)}).groupBy(*keys).agg(F.max_by(F.struct(value, "_before"), order).alias("_l"))
    return rows.select(*keys, F.col("_l")[value].alias("last"), (F.col("_l")[value] - F.col("_l")["_before"]).alias("last_step"))


def daily_max(df: DataFrame, when: str, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Daily maxima on a complete calendar of each series; days without rows have nulls."""
    days = df.groupBy(*keys, F.to_date(when).alias("date")).agg(*[F.max(v).alias(v) for v in values])
    spine = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    spine = spine.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("date"))
    return spine.join(days, [*keys, "date"], "left")


def filled_along(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """df with name: value, else the last known before it, else the first after it."""
    rows = carried(df, keys, [order], value, "_before", "_after")
    return rows.withColumn(name, F.coalesce("_before", "_after")).drop("_before", "_after")


def gradient(df: DataFrame, value: str, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """df with name: central difference inside a line of cells, one-sided at its ends."""

    def columns(c, w) -> dict[str, Column]:
        left, right = F.lag(c(value)).over(w), F.lead(c(value)).over(w)
        return {name: F.when(left.isNull(), right - c(value)).when(right.isNull(), c(value) - left).otherwise((right - left) / 2)}

    return along(df, keys, [order], columns)


def nearest(left: DataFrame, right: DataFrame, *, keys: Sequence[str], when: str, right_when: str, values: Sequence[str], tolerance_s: float | None = None) -> DataFrame:
    """left with the nearest_<value> of the right row nearest in time in its series, the earlier one on a tie.

    Both sides are merged in time order; each left row takes the last right row up to it and the next one:
    no pairs are made, and a series may be of any size. right_when and the values keep their names with a prefix nearest_.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.withColumns({"_t": us(when), "_side": F.lit(1), "_r": F.lit(None).cast(_struct(right, [right_when, *values]))})
    b = right.select(*keys, us(right_when).alias("_t"), F.lit(0).alias("_side"), F.struct(us(right_when).alias("_t"), *[right_when, *values]).alias("_r"))
    both = a.unionByName(b.filter("_t is not null"), allowMissingColumns=True)
    both = carried(both, keys, ["_t", "_side"], "_r", "_b", "_a").filter("_side = 1")
    back, ahead = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    pick = F.when(F.col("_t").isNull(), F.lit(None)).when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    both = both.withColumn("_n", pick)
    if tolerance_s is not None:
        both = both.withColumn("_n", F.when(F.abs(F.col("_n._t") - F.col("_t")) <= tolerance_s * 1e6, F.col("_n")))
    return both.select(*left.columns, *[F.col(f"_n.{c}").alias(f"nearest_{c}") for c in (right_when, *values)])


def _struct(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<_t:bigint," + ",".join(f"`{c}`:{kinds[c]}" for c in columns) + ">"


def interpolated(left: DataFrame, right: DataFrame, *, keys: Sequence[str], when: str, right_when: str, value: str, max_gap_s: float | None = None) -> DataFrame:
    """left with linear_<value>: between the right rows before and after it; null outside or across a longer gap."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.withColumns({"_t": us(when), "_side": F.lit(1), "_r": F.lit(None).cast("struct<_t:bigint,_v:double>")})
    b = right.filter(F.col(value).isNotNull()).select(*keys, us(right_when).alias("_t"), F.lit(0).alias("_side"), F.struct(us(right_when).alias("_t"), F.col(value).cast("double").alias("_v")).alias("_r"))
    both = a.unionByName(b.filter("_t is not null"), allowMissingColumns=True)
    both = carried(both, keys, ["_t", "_side"], "_r", "_b", "_a").filter("_side = 1")
    gap = F.col("_a._t") - F.col("_b._t")
    share = (F.col("_t") - F.col("_b._t")) / F.nullif(gap, F.lit(0))
    line = F.col("_b._v") + F.coalesce(share, F.lit(0.0)) * (F.col("_a._v") - F.col("_b._v"))
    if max_gap_s is not None:
        line = F.when(gap <= max_gap_s * 1e6, line)
    return both.select(*left.columns, line.alias(f"linear_{value}"))
