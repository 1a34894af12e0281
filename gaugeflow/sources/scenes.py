"""Scene metadata: item documents, product XML, and what file names tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common names of bands.
COMMON = {"B01": "coastal", "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge071", "B06": "rededge075", "B07": "rededge078", "B08": "nir", "B8A": "nir08", "B09": "nir09", "B11": "swir16", "B12": "swir22"}
#: Sets of subswaths that are adjacent.
ADJACENT = ("1", "2", "3", "12", "23", "123")


def read_items(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Item documents of a folder, one to a file; broken ones have a _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_product_xml(spark: SparkSession, path: str, row: str, schema=None) -> DataFrame:
    """Rows of the element row of product XML files."""
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def acquisition_date(safe_name: Column) -> Column:
    """Date of a product's name: the part after the fifth underscore, its first eight digits."""
    return F.try_to_timestamp(F.substring(F.get(F.split(safe_name, "_"), F.lit(5)), 1, 8), F.lit("yyyyMMdd")).cast("date")


def subswath(tiff_name: Column) -> Column:
    return F.regexp_extract(tiff_name, r"-iw([123])-", 1).try_cast("int")


def burst(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d{6})_IW", 1)


def adjacent(scenes: DataFrame) -> DataFrame:
    """(date, subswaths, valid) of scenes (date, subswath): whether a date's subswaths lie side by side."""
    rows = scenes.groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("subswath")), "").alias("subswaths"))
    return rows.withColumn("valid", F.col("subswaths").isin(*ADJACENT))


def common_name(band: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in COMMON.items() for x in pair]), F.upper(band))


def kind_of(path: Column) -> Column:
    """insitu, raster, s1_slc, s1_grd, s2, or asf for anything else."""
    name = F.upper(F.regexp_extract(path, r"([^/]*)/*$", 1))
    low = F.lower(name)
    return (
        F.when(low.rlike(r"\.(csv|txt|xlsx?)$"), "insitu")
        .when(low.rlike(r"\.(tiff?|jp2)$"), "raster")
        .when(name.rlike("^S1[A-D]_.*_SLC_"), "s1_slc")
        .when(name.rlike("^S1[A-D]_.*_GRD"), "s1_grd")
        .when(name.rlike("^S2[A-D]_"), "s2")
        .otherwise("asf")
    )


def clear_scenes(scenes: DataFrame, most_percent: float) -> DataFrame:
    """Scenes whose cloud, snow, shadow and dark shares add up to less than most_percent, by time."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in ("cloud", "snow_or_ice", "cloud_shadow", "dark_area")), F.lit(0.0))
    return scenes.filter(total < most_percent).orderBy("datetime")


def pixel_to_map(row: Column, col: Column, geotransform: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Map coordinates of a pixel's upper left corner."""
    x0, dx, rx, y0, ry, dy = map(float, geotransform)
    return x0 + col * dx + row * rx, y0 + col * ry + row * dy


def aligned_bounds(west: Column, south: Column, east: Column, north: Column, step: float) -> list[Column]:
    """Bounds widened to whole steps."""
    return [F.floor(west / step) * step, F.floor(south / step) * step, F.ceil(east / step) * step, F.ceil(north / step) * step]
