"""Displacement from pairs of acquisitions: reference offsets, the network solution, residuals, velocity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.shards import running_total
from gaugeflow.session import cut

#: Least coherence and used share of a pair's reference pixels.
LEAST = {"coherence": 0.20, "pixels": 10, "fraction": 0.3, "median_coherence": 0.35}


def coherent(pixels: DataFrame) -> DataFrame:
    """Pixels with finite phase and a coherence of at least 0.20."""
    good = F.col("phase").isNotNull() & ~F.isnan("phase") & F.col("corr").isNotNull() & ~F.isnan("corr")
    return pixels.filter(good & (F.col("corr") >= LEAST["coherence"]))


def reference_offsets(pixels: DataFrame) -> DataFrame:
    """(pair, offset, component, pixels, median_coherence) of reference pixels (pair, phase, corr, comp).

    The offset is the coherence-weighted median of phase in the pair's largest component (the lowest label on
    a tie); where the weights split in half, the mean of the two middle values. Weights are added up by a running
    total over range partitions, so that a pair's reference area may be of any size.
    """
    use = pixels.filter("phase is not null and not isnan(phase) and not isnan(corr) and corr > 0 and comp > 0")
    sizes = use.groupBy("pair", "comp").count()
    largest = sizes.groupBy("pair").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("comp"))
    rows = use.join(largest, ["pair", "comp"]).select("pair", "comp", "phase", "corr")
    found = rows.groupBy("pair").agg((F.sum("corr") / 2).alias("_half"), F.first("comp").alias("component"), F.count(F.lit(1)).alias("pixels"), F.median("corr").alias("median_coherence"))
    summed = cut(running_total(rows, ["pair"], ["phase", "corr"], "corr", "_sum"))
    halves = summed.join(found.select("pair", "_half"), "pair")
    even = F.abs(F.col("_sum") - F.col("_half")) <= 1e-8 + 1e-5 * F.abs("_half")
    middle = halves.filter((F.col("_sum") >= F.col("_half")) | even).groupBy("pair").agg(F.min(F.struct("_sum", "phase", even.alias("even"))).alias("_m"))
    after = summed.join(middle, "pair").filter(F.col("_sum") > F.col("_m._sum")).groupBy("pair").agg(F.min(F.struct("_sum", "phase"))["phase"].alias("_next"))
    offset = F.when(F.col("_m.even") & F.col("_next").isNotNull(), (F.col("_m.phase") + F.col("_next")) / 2).otherwise(F.col("_m.phase"))
    return found.join(middle, "pair", "left").join(after, "pair", "left").select("pair", offset.alias("offset"), "component", "pixels", "median_coherence")


def accepted(offsets: DataFrame, totals: DataFrame) -> DataFrame:
    """offsets with fraction of the pair's reference pixels (pair, total) and accepted."""
    rows = offsets.join(totals, "pair").withColumn("fraction", F.col("pixels") / F.nullif(F.col("total"), F.lit(0)))
    good = (F.col("pixels") >= LEAST["pixels"]) & (F.col("fraction") >= LEAST["fraction"]) & (F.col("median_coherence") >= LEAST["median_coherence"])
    return rows.withColumn("accepted", F.coalesce(good, F.lit(False)))


def solve_network(pixels: DataFrame, mm_per_radian: float) -> DataFrame:
    """(y, x, date, los_mm): displacement at each date, zero at the first, from pair phases.

    pixels: y, x, ref, rep, phase, corr. For each pixel, weighted least squares over its valid pairs; dates
    that its pairs don't join to the first date of the network are null. One pixel's pairs fit one task.
    """
    bounds = pixels.agg(F.array_sort(F.collect_set("ref")).alias("a"), F.array_sort(F.collect_set("rep")).alias("b")).first()
    dates = sorted({*(bounds["a"] or []), *(bounds["b"] or [])})
    place = {d: i for i, d in enumerate(dates)}

    def solve(part: pd.DataFrame) -> np.ndarray:
        part = part.dropna(subset=["phase", "corr"])
        part = part[part["corr"] > 0]
        a, b = part["ref"].map(place).to_numpy(int), part["rep"].map(place).to_numpy(int)
        reached, grew = {0}, True
        while grew:
            more = {j for i, j in zip(a, b, strict=True) if i in reached} | {i for i, j in zip(a, b, strict=True) if j in reached}
            grew = not more <= reached
            reached |= more
        out = np.full(len(dates), np.nan)
        if len(part) and len(reached) > 1:
            unknown = sorted(reached - {0})
            column = {d: k for k, d in enumerate(unknown)}
            design = np.zeros((len(part), len(unknown)))
            for row, (i, j) in enumerate(zip(a, b, strict=True)):
                if j in column:
                    design[row, column[j]] = 1
                if i in column:
                    design[row, column[i]] = -1
            inside = np.isin(a, list(reached))
            root = np.sqrt(part["corr"].to_numpy())[inside]
            found = np.linalg.lstsq(design[inside] * root[:, None], part["phase"].to_numpy()[inside] * root, rcond=None)[0]
            out[0] = 0.0
            out[unknown] = found * mm_per_radian
        return out

    def group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": key[0], "x": key[1], "date": dates, "los_mm": solve(part)})

    kinds = dict(pixels.dtypes)
    return pixels.groupBy("y", "x").applyInPandas(group, f"y {kinds['y']}, x {kinds['x']}, date {kinds['ref']}, los_mm double")


def weighted_rmse(df: DataFrame, residual: str, weight: str, keys: list[str]) -> DataFrame:
    """(keys, rmse): root of the weighted mean square residual; null without a valid row."""
    w = F.when(F.col(residual).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.sqrt(F.sum(w * F.col(residual) * F.col(residual)) / F.nullif(F.sum(w), F.lit(0.0))).alias("rmse"))


def velocities(df: DataFrame, value: str, date: str, keys: list[str]) -> DataFrame:
    """(keys, mm_per_year): slope of the least-squares line over days, times 365.25."""
    return df.groupBy(*keys).agg((F.regr_slope(F.col(value), F.unix_date(date)) * 365.25).alias("mm_per_year"))


def residuals(pairs: DataFrame, displacement: DataFrame, mm_per_radian: float) -> DataFrame:
    """pairs with residual_mm: the pair's phase in mm less the difference of its dates' displacement."""
    late = displacement.select("y", "x", F.col("date").alias("rep"), F.col("los_mm").alias("_late"))
    early = displacement.select("y", "x", F.col("date").alias("ref"), F.col("los_mm").alias("_early"))
    joined = pairs.join(late, ["y", "x", "rep"], "left").join(early, ["y", "x", "ref"], "left")
    return joined.withColumn("residual_mm", F.col("phase") * mm_per_radian - (F.col("_late") - F.col("_early"))).drop("_late", "_early")


def pair_statistics(pixels: DataFrame) -> DataFrame:
    """(pair, n_cells, n_valid, valid_fraction, mean_coherence) over the pixels of each pair."""
    valid = F.col("phase").isNotNull() & ~F.isnan("phase")
    return pixels.groupBy("pair").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(valid).alias("n_valid"), (F.count_if(valid) / F.count(F.lit(1))).alias("valid_fraction"), F.avg(F.when(valid, F.col("corr"))).alias("mean_coherence"))


def date_statistics(displacement: DataFrame) -> DataFrame:
    """(date, valid_fraction, mean, least, most) of displacement; nulls aren't valid."""
    return displacement.groupBy("date").agg((F.count("los_mm") / F.count(F.lit(1))).alias("valid_fraction"), F.avg("los_mm").alias("mean"), F.min("los_mm").alias("least"), F.max("los_mm").alias("most"))


def complete_dates(bursts: DataFrame) -> DataFrame:
    """(date, complete): whether each subswath has as many distinct bursts at the date as at its best date.

    bursts: date, subswath, burst. One wide row for each date; subswaths are few.
    """
    counts = bursts.groupBy("date", "subswath").agg(F.countDistinct("burst").alias("n"))
    most = counts.groupBy("subswath").agg(F.max("n").alias("most"))
    grid = bursts.select("date").distinct().crossJoin(F.broadcast(most))  # at most a handful of subswaths
    seen = grid.join(counts, ["date", "subswath"], "left")
    return seen.groupBy("date").agg(F.bool_and(F.coalesce("n", F.lit(0)) == F.col("most")).alias("complete"))


def long_rows(wide: DataFrame, values: str, keys: list[str], place: str = "place", value: str = "value") -> DataFrame:
    """(keys, place, value): one row for each element of an array, numbered from 0; an empty or null array gives none."""
    return wide.select(*keys, F.posexplode(values).alias(place, value))
