"""Pixel tables: indices, water masks, class shares, labels. One row is one pixel of one scene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.scores import WATER, band_regression, least_angle, shadow_index
from gaugeflow.operators.network import components
from gaugeflow.operators.shards import running_total

NODATA = -32768
#: Bands of the indices, and the classes of the scene classification.
NIR, VNIR, ANGLE = ("b06", "b07", "b08", "b8a"), ("b01", "b02", "b06", "b07", "b08", "b8a"), ("b01", "b02", "b03", "b04", "b05", "b06", "b07", "b08", "b8a", "b11", "b12")
CLASSES = (
    "no_data", "saturated_or_defective", "dark_area", "cloud_shadow", "vegetation", "not_vegetated",
    "water", "unclassified", "cloud_medium_probability", "cloud_high_probability", "thin_cirrus", "snow_or_ice",
)


def masked(pixels: DataFrame, bands: Sequence[str], offsets: Sequence[int], scl: str = "scl") -> DataFrame:
    """Pixels of class 0 and 1 become nodata in all bands; the others get their band's offset."""
    return pixels.withColumns({b: F.when(F.col(scl) <= 1, NODATA).otherwise(F.col(b) + o) for b, o in zip(bands, offsets, strict=True)})


def class_shares(pixels: DataFrame, scene: str = "scene_id", scl: str = "scl") -> DataFrame:
    """(scene, one share in percent for each class, cloud): in one pass; classes above 11 are an error."""
    n = F.count(scl)
    shares = [F.round(F.count_if(F.col(scl) == i) * 100.0 / n, 6).alias(name) for i, name in enumerate(CLASSES)]
    cloud = F.round(F.count_if(F.col(scl).isin(8, 9, 10)) * 100.0 / n, 6).alias("cloud")
    checked = pixels.withColumn(scl, F.when(F.col(scl).between(0, 11) | F.col(scl).isNull(), F.col(scl)).otherwise(F.raise_error(F.lit("class above 11")).cast("int")))
    return checked.groupBy(scene).agg(*shares, cloud)


def pixel_medians(pixels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """(row, col, bands): exact medians over all scenes, nodata included as the number it is."""
    return pixels.groupBy("row", "col").agg(*[F.median(b).alias(b) for b in bands])


def with_indices(pixels: DataFrame, references: Sequence[Sequence[float]]) -> DataFrame:
    """pixels with shadow, slope, intercept, swir and angle."""
    slope, intercept = band_regression([F.col(b) for b in VNIR])
    swir = (F.col("b11").cast("double") + F.col("b12")) / 2
    spectrum = F.array(*[F.col(b).cast("double") for b in ANGLE])
    return pixels.withColumns({"shadow": shadow_index([F.col(b) for b in NIR]), "slope": slope, "intercept": intercept, "swir": swir, "angle": least_angle(spectrum, references)})


def is_water() -> Column:
    """Pixels to keep in the mask over all scenes."""
    c, t = F.col, WATER
    return (c("shadow") > t["shadow"]) & (c("slope") < t["slope"]) & (c("intercept") > t["intercept"]) & (c("swir") < t["swir"]) & (c("angle") > t["angle"]) & (c("b02") < t["blue"])


def not_water() -> Column:
    """Pixels to remove from the mask in one scene; a value equal to its threshold stays."""
    c, t = F.col, WATER
    dry = (c("shadow") < t["shadow"]) | (c("slope") > t["slope"]) | (c("intercept") < t["intercept"]) | (c("swir") > t["swir"]) | (c("angle") < t["angle"]) | (c("b02") > t["blue"])
    return dry | (c("scl") >= 8) | (c("scl") <= 1)


def labelled(mask: DataFrame, least_pixels: int = 4) -> DataFrame:
    """(row, col, label): 4-neighbour bodies of the pixels of mask (row, col), 1 for the largest; ties by place.

    Bodies under least_pixels pixels fall away. Neighbours are found by two equi-joins, bodies by stars.
    """
    cells = mask.select("row", "col").distinct()
    node = F.shiftleft(F.col("row").cast("bigint"), 32) + F.col("col")
    below = cells.select(node.alias("a"), (F.col("row") + 1).cast(cells.schema["row"].dataType).alias("row"), "col")
    beside = cells.select(node.alias("a"), "row", (F.col("col") + 1).cast(cells.schema["col"].dataType).alias("col"))
    edges = below.unionByName(beside).join(cells, ["row", "col"]).select("a", node.alias("b"))
    bodies = components(cells.select(node.alias("node")), edges)
    sizes = bodies.groupBy("component").count().filter(F.col("count") >= least_pixels)
    ranks = running_total(sizes.withColumns({"_one": F.lit(1), "_less": -F.col("count")}), [], ["_less", "component"], "_one", "label").select("component", F.col("label").cast("int").alias("label"))
    place = {"row": F.shiftright("node", 32), "col": F.col("node").bitwiseAND((1 << 32) - 1)}
    return bodies.join(ranks, "component").select(*[c.cast(cells.schema[n].dataType).alias(n) for n, c in place.items()], "label")


def mask_share(mask: DataFrame, flag: str) -> DataFrame:
    """Share of set pixels in percent."""
    return mask.agg(F.round(F.avg(F.col(flag).cast("int")) * 100, 4).alias("share"))


def hillside(cells: DataFrame, value: str, cell_m: float = 1.0) -> DataFrame:
    """cells (row, col, value) with slope_deg from the two-dimensional gradient."""
    from gaugeflow.functions.scores import slope_degrees
    from gaugeflow.operators.series import gradient

    cells = gradient(gradient(cells, value, ["col"], "row", "_dy"), value, ["row"], "col", "_dx")
    dx, dy = (F.coalesce(F.col(c) / cell_m, F.lit(0.0)) for c in ("_dx", "_dy"))
    return cells.withColumn("slope_deg", slope_degrees(dx, dy)).drop("_dx", "_dy")


def sampled(cells: DataFrame, points: DataFrame, value: str = "value") -> DataFrame:
    """points (y, x in cells, fractions allowed) with value: bilinear between the four cells around.

    A point whose four cells aren't all there is null. Each point asks for four cells by one equi-join.
    """
    row, col = F.floor("y"), F.floor("x")
    fy, fx = F.col("y") - row, F.col("x") - col
    corners = [(0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)]
    asked = F.explode(F.array(*[F.struct((row + i).alias("row"), (col + j).alias("col"), w.alias("w")) for i, j, w in corners]))
    rows = points.withColumn("_id", F.struct(*points.columns)).select("_id", asked.alias("_c")).select("_id", "_c.*").filter("w > 0")
    grid = cells.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col(value).alias("_v"))
    found = rows.join(grid, ["row", "col"], "left").groupBy("_id").agg(F.sum(F.col("w") * F.col("_v")).alias(value), F.bool_and(F.col("_v").isNotNull()).alias("_all"))
    return found.select("_id.*", F.when(F.col("_all"), F.col(value)).alias(value))
