"""Rule-based quality control: one aggregate pass over a dataset's rows, whatever the number of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Physical limits of water measurements.
LIMITS = {"ph": (0.0, 14.0), "do": (0.0, 20.0), "conductivity": (0.0, 5000.0), "turbidity": (0.0, 1000.0), "temperature": (-5.0, 50.0)}
#: Parts of names of columns that hold no measurement.
META = ("lat", "lon", "timestamp", "date", "platform", "qc")
#: Limits of raster scenes.
RASTER = {"max_null": 0.02, "min_snr": 30.0, "required": ("crs", "cloud_cover_pct", "sensor_type")}
RANK = {"Pass": 0, "Warn": 1, "Fail": 2}


def measurement_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if not any(part in c.lower() for part in META)]


def out_of_range(columns: Sequence[str], limits: Mapping[str, tuple[float, float]] = LIMITS) -> dict[str, Column]:
    """For each column whose first word is a limited measurement: whether its value is out of range (null isn't)."""
    found = {}
    for c in columns:
        if (rule := limits.get(c.lower().split(" ")[0])) is not None:
            found[c] = F.coalesce(~F.col(f"`{c}`").cast("double").between(*rule), F.lit(False))
    return found


def row_kind(qc: Column, platform: Column) -> Column:
    """'office' (QC 0 and a platform named OFFICE), 'fault' (any other QC 0) or 'sensor'."""
    office = F.coalesce(F.upper(platform).contains("OFFICE"), F.lit(False))
    bad = F.coalesce(qc.cast("int") == 0, F.lit(False))
    return F.when(bad & office, "office").when(bad, "fault").otherwise("sensor")


def check_readings(df: DataFrame, dataset: str, *, key: str | None = None, qc: str | None = None, platform: str | None = None, limits: Mapping[str, tuple[float, float]] = LIMITS) -> DataFrame:
    """One row for each dataset: counts by finding, share of missing cells and status.

    (dataset, n_rows, duplicates, office_rows, fault_rows, missing_rows, range_rows, missing_fraction, status).
    Fail: repeated keys, faults, or values of sensor rows out of range; Warn: office rows, or sensor rows
    without a measurement; else Pass. Without key there are no repeats, without qc and platform all rows are
    sensor rows. NaN counts as missing. Repeats are counted by (dataset, key), pre-aggregated; a dataset of
    any size is split over tasks.
    """
    data = [c for c in df.columns if c not in (dataset, key)]
    kinds = dict(df.dtypes)
    null = {c: F.col(f"`{c}`").isNull() | (F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.lit(False)) for c in data}
    rows = df.withColumns({c: F.when(~null[c], F.col(f"`{c}`")) for c in data if kinds[c] in ("double", "float")})
    kind = row_kind(F.col(qc), F.col(platform)) if qc and platform else F.lit("sensor")
    sensor = kind == "sensor"
    lost = [F.col(f"`{c}`").isNull() for c in measurement_columns(data)]
    wrong = list(out_of_range(data, limits).values())

    def any_of(tests: list[Column]) -> Column:
        return F.array_contains(F.array(*tests), True) if tests else F.lit(False)

    found = rows.groupBy(dataset).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(kind == "office").alias("office_rows"),
        F.count_if(kind == "fault").alias("fault_rows"),
        F.count_if(sensor & any_of(lost)).alias("missing_rows"),
        F.count_if(sensor & any_of(wrong)).alias("range_rows"),
        (F.sum(sum((F.col(f"`{c}`").isNull().cast("int") for c in data), F.lit(0))) / (F.count(F.lit(1)) * max(len(data), 1))).alias("missing_fraction"),
    )
    if key:
        repeats = df.groupBy(dataset, key).count().groupBy(dataset).agg(F.sum(F.col("count") - 1).alias("duplicates"))
        found = found.join(repeats, dataset)
    else:
        found = found.withColumn("duplicates", F.lit(0).cast("bigint"))
    fail = (F.col("duplicates") > 0) | (F.col("fault_rows") > 0) | (F.col("range_rows") > 0)
    warn = (F.col("office_rows") > 0) | (F.col("missing_rows") > 0)
    order = ["n_rows", "duplicates", "office_rows", "fault_rows", "missing_rows", "range_rows", "missing_fraction"]
    return found.select(dataset, *order, F.when(fail, "Fail").when(warn, "Warn").otherwise("Pass").alias("status"))


def check_scenes(scenes: DataFrame, *, strict: bool = False) -> DataFrame:
    """scenes with errors and status, from the columns null_pixel_pct, is_geometrically_aligned, snr,
    sensor_type and metadata_keys (array of the metadata's keys).

    Incomplete metadata sets Warn even after a failure of the checks before it, unless strict; a low
    signal-to-noise ratio of a hyperspectral scene sets Fail again.
    """
    nulls = F.coalesce(F.col("null_pixel_pct") > RASTER["max_null"], F.lit(False))
    skew = ~F.coalesce("is_geometrically_aligned", F.lit(False))
    lacking = F.size(F.array_except(F.array(*map(F.lit, RASTER["required"])), F.coalesce("metadata_keys", F.array().cast("array<string>")))) > 0
    noisy = F.coalesce(F.col("sensor_type") == "hyperspectral", F.lit(False)) & (F.coalesce("snr", F.lit(0.0)) < RASTER["min_snr"])
    errors = F.array_compact(F.array(F.when(nulls, "null pixels"), F.when(skew, "alignment"), F.when(lacking, "metadata"), F.when(noisy, "signal to noise")))
    early = nulls | skew
    status = F.when(noisy, "Fail").when(early & lacking, "Fail" if strict else "Warn").when(early, "Fail").when(lacking, "Warn").otherwise("Pass")
    return scenes.withColumns({"errors": errors, "status": status})


def worst(status: Column) -> Column:
    """Aggregate: Fail before Warn before Pass."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return F.max_by(status, F.try_element_at(rank, status))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, copies) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order, nulls first; rows that tie in order must be equal. Keys are pre-aggregated."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_first")).select("_first.*")
