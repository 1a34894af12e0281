"""The risk table: motion of each cell, with the weather and air of its place, scored day by day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.scores import BOUNDS, linear_score, motion_score, risk_class, risk_score, us_aqi
from gaugeflow.operators.joins import first_location, nearest_location
from gaugeflow.operators.series import climate_features, steps

#: Other names of the base table's columns.
NAMES = {"displacement": "los_mm", "los": "los_mm", "risk": "insar_risk_score_base", "latitude": "lat", "longitude": "lon", "time": "date"}


def normal_names(base: DataFrame) -> DataFrame:
    """base with the usual names of its columns; a name that is there already stays."""
    return base.withColumnsRenamed({old: new for old, new in NAMES.items() if old in base.columns and new not in base.columns})


def risk_table(base: DataFrame, climate: DataFrame, air: DataFrame, cell: str = "cell_id") -> DataFrame:
    """base (cell, date, los_mm [, lat, lon, slope_deg]) with steps, weather, air, score and class.

    climate: location, date, precipitation_sum, et0, temperature_max [, lat, lon]; air: location, date,
    pm2_5. Cells take the nearest location, or the first one where climate has no coordinates. Without a
    slope the terrain scores 0; where weather or air is missing the score is null and the class Low.
    """
    base = steps(normal_names(base), "los_mm", [cell], "date")
    placed = {"lat", "lon"} <= {*climate.columns} & {*base.columns}
    cells = base.groupBy(cell).agg(F.first("lat").alias("lat"), F.first("lon").alias("lon")) if placed else base.select(cell).distinct()
    cells = nearest_location(cells, climate.select("location", "lat", "lon")) if placed else first_location(cells, climate)
    weather = climate_features(climate.drop("lat", "lon"))
    weather = weather.withColumnsRenamed({c: f"climate_{c}" for c in weather.columns if c not in ("date", "location")})
    air = air.withColumn("us_aqi", us_aqi(F.col("pm2_5")))
    air = air.withColumnsRenamed({c: f"air_{c}" for c in air.columns if c not in ("date", "location")})
    rows = base.join(cells.select(cell, "location"), cell, "left").join(weather, ["date", "location"], "left").join(air, ["date", "location"], "left")
    motion = motion_score(F.col("velocity"), F.col("step"), F.col("los_mm"))
    terrain = linear_score(F.col("slope_deg"), *BOUNDS["slope"]) if "slope_deg" in rows.columns else F.lit(0.0)
    score = risk_score(motion, terrain, linear_score(F.col("climate_precip_7d_mm"), *BOUNDS["rain_7d"]), linear_score(F.col("air_pm2_5"), *BOUNDS["pm2_5"]))
    rows = rows.withColumn("risk_score", score)
    return rows.withColumn("risk_class", risk_class(score))
