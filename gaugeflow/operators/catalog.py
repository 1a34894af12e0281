"""Catalog items: building, flattening, search, validation, upsert, coverage."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.nearby import boxes_of


def bbox_polygon(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed ring of a box as a polygon's coordinates."""
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def insitu_items(datasets: DataFrame, collection: str) -> DataFrame:
    """Items of in-situ datasets (dataset_id, lon_min, lat_min, lon_max, lat_max, start, end, sensor_type, epsg, schema)."""
    box = [F.col(c).cast("double") for c in ("lon_min", "lat_min", "lon_max", "lat_max")]
    placed = F.col("lon_min").isNotNull()
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return datasets.select(
        F.col("dataset_id").alias("id"),
        F.lit(collection).alias("collection"),
        F.lit("Feature").alias("type"),
        F.lit("1.0.0").alias("stac_version"),
        F.when(placed, F.array(*box)).alias("bbox"),
        F.when(placed, bbox_polygon(*box)).alias("geometry"),
        F.struct(
            F.date_format("start", iso).alias("datetime"),
            F.date_format("start", iso).alias("start_datetime"),
            F.date_format("end", iso).alias("end_datetime"),
            F.col("sensor_type"),
            F.regexp_extract("epsg", r"(\d+)$", 1).try_cast("int").alias("proj:epsg"),
        ).alias("properties"),
        F.create_map(F.lit("data"), F.struct(F.concat("dataset_id", F.lit(".csv")).alias("href"), F.array(F.lit("data")).alias("roles"), F.col("schema").alias("table:columns"))).alias("assets"),
    )


def flat_assets(items: DataFrame, asset: str | None = None) -> DataFrame:
    """One row for each item and asset: (id, collection, platform, timestamp, cloud_cover, bbox, asset, href, type, roles)."""
    rows = items.select("id", "collection", F.col("properties.platform").alias("platform"), F.col("properties.datetime").alias("timestamp"), F.col("properties.`eo:cloud_cover`").alias("cloud_cover"), "bbox", F.explode(F.map_entries("assets")).alias("_a"))
    rows = rows.select("*", F.col("_a.key").alias("asset"), F.col("_a.value.href").alias("href"), F.col("_a.value.type").alias("type"), F.col("_a.value.roles").alias("roles")).drop("_a")
    return rows.filter(F.col("asset") == asset) if asset else rows


def search(items: DataFrame, *, bbox: Sequence[float] | None = None, start: str | None = None, end: str | None = None, collections: Sequence[str] | None = None) -> DataFrame:
    """Items that meet a box (edges included, boxes may cross 180 degrees) and a closed interval of time."""
    if collections:
        items = items.filter(F.col("collection").isin(*collections))
    when = F.col("properties.datetime").try_cast("timestamp")
    if start:
        items = items.filter(when >= F.lit(start).cast("timestamp"))
    if end:
        items = items.filter(when <= F.lit(end).cast("timestamp"))
    if bbox:
        west, south, east, north = map(float, bbox)
        b = F.col("bbox")
        six = F.size(b) == 6
        w, s, e, n = b[0], b[1], F.when(six, F.get(b, F.lit(3))).otherwise(F.get(b, F.lit(2))), F.when(six, F.get(b, F.lit(4))).otherwise(F.get(b, F.lit(3)))
        meets = lambda a, z: (w <= z) & (e >= a)
        crossing = (w <= east) | (e >= west)
        items = items.filter(F.size(b).isin(4, 6)).filter((s <= north) & (n >= south) & F.when(w <= e, meets(west, east)).otherwise(crossing))
    return items


def upsert(catalog: DataFrame, new: DataFrame, keys: Sequence[str] = ("collection", "id")) -> DataFrame:
    """catalog with new items in place of those of the same key."""
    return catalog.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def add_missing(table: DataFrame, defaults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with those rows of defaults whose key it lacks."""
    return table.unionByName(defaults.join(table.select(*keys), list(keys), "left_anti"))


def moved(items: DataFrame, prefix: str) -> DataFrame:
    """items with every asset's href put below prefix, without its folders."""
    return items.withColumn("assets", F.transform_values("assets", lambda k, a: a.withField("href", F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_extract(a.href, r"([^/]*)$", 1)))))


def item_errors(items: DataFrame, collections: DataFrame | None = None) -> DataFrame:
    """(id, errors): required fields, start before end, a box inside the world, and a known collection."""
    p = "properties."
    start, end = (F.col(p + c).try_cast("timestamp") for c in ("start_datetime", "end_datetime"))
    b = F.col("bbox")
    # with six numbers the third and sixth are heights
    east, north = (F.when(F.size(b) == 6, F.get(b, F.lit(i + 1))).otherwise(F.get(b, F.lit(i))) for i in (2, 3))
    inside = (F.get(b, F.lit(0)) >= -180) & (east <= 180) & (F.get(b, F.lit(1)) >= -90) & (north <= 90)
    outside = F.size(b).isin(4, 6) & ~F.coalesce(inside, F.lit(False))
    known = F.lit(True)
    if collections is not None:
        items = items.join(F.broadcast(collections.select(F.col("collection").alias("_c")).distinct()), F.col("collection") == F.col("_c"), "left")
        known = F.col("_c").isNotNull() | F.col("collection").isNull()
    tests = {
        "no id": F.col("id").isNull(),
        "no collection": F.col("collection").isNull(),
        "unknown collection": ~known,
        "no datetime": F.col(p + "datetime").isNull(),
        "empty interval": start >= end,
        "no bbox": b.isNull() | (F.size(b) == 0),
        "bbox of another length": (F.size(b) > 0) & ~F.size(b).isin(4, 6),
        "bbox outside the world": outside,
    }
    return items.select("id", F.array_compact(F.array(*[F.when(t, F.lit(m)) for m, t in tests.items()])).alias("errors"))


def raster_assets(items: DataFrame, media_types: Sequence[str] = ("image/tiff", "image/jp2"), roles: Sequence[str] = ("data",)) -> DataFrame:
    """items with raster_assets: those of a raster media type, parameters apart, or with one of the roles."""
    keep = F.map_filter("assets", lambda k, a: F.coalesce(F.trim(F.substring_index(a.type, ";", 1)).isin(*media_types), F.lit(False)) | F.coalesce(F.arrays_overlap(a.roles, F.array(*map(F.lit, roles))), F.lit(False)))
    return items.withColumn("raster_assets", keep)


def covered_share(boxes: Sequence[Sequence[float]], area: Sequence[float]) -> float:
    """Share of a box that the union of boxes covers, exact, by compressing coordinates."""
    west, south, east, north = area
    clipped = [(max(a, west), max(b, south), min(c, east), min(d, north)) for a, b, c, d in boxes]
    clipped = [r for r in clipped if r[0] < r[2] and r[1] < r[3]]
    if not clipped:
        return 0.0
    xs, ys = np.unique([v for r in clipped for v in (r[0], r[2])]), np.unique([v for r in clipped for v in (r[1], r[3])])
    full = np.zeros((len(xs) - 1, len(ys) - 1), bool)
    for a, b, c, d in clipped:
        full[np.searchsorted(xs, a) : np.searchsorted(xs, c), np.searchsorted(ys, b) : np.searchsorted(ys, d)] = True
    return float((np.outer(np.diff(xs), np.diff(ys)) * full).sum() / ((east - west) * (north - south)))


def collection_summary(items: DataFrame) -> DataFrame:
    """(collection, n_items, mean_cloud, n_dates, west, south, east, north), extents of all usable boxes as from `boxes_of`.

    A box that crosses 180 degrees counts as its two parts, so a collection with one reaches from -180 to 180.
    """
    found = items.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.avg("properties.`eo:cloud_cover`").alias("mean_cloud"),
        F.countDistinct(F.to_date(F.col("properties.datetime").try_cast("timestamp"))).alias("n_dates"),
    )
    boxes = boxes_of(items.select(F.struct("collection").alias("key"), "bbox"), "key", "bbox").groupBy(F.col("region.collection").alias("_c"))
    boxes = boxes.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    return found.join(boxes, F.col("collection").eqNullSafe(F.col("_c")), "left").drop("_c")


def renamed_assets(items: DataFrame, names: dict[str, str]) -> DataFrame:
    """items with just the assets that names has, under their new names."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    kept = F.map_filter("assets", lambda k, a: k.isin(*names))
    return items.withColumn("assets", F.transform_keys(kept, lambda k, a: F.try_element_at(table, k)))


def with_band_assets(items: DataFrame, prefix: str) -> DataFrame:
    """items with one more asset for each band file (array of paths): B02 of ..._B02.tif, below prefix."""
    band = lambda p: F.upper(F.regexp_extract(p, r"_(B\d[0-9A]|SCL)[_.]", 1))
    kind = items.schema["assets"].dataType.valueType
    entry = lambda p: F.from_json(F.to_json(F.struct(F.concat(F.lit(prefix.rstrip("/") + "/"), F.regexp_extract(p, r"([^/]*)$", 1)).alias("href"), F.lit("image/tiff; application=geotiff").alias("type"), F.array(F.lit("data")).alias("roles"))), kind)
    named = F.filter(F.col("band_files"), lambda p: band(p) != "")
    more = F.map_from_entries(F.transform(named, lambda p: F.struct(band(p), entry(p))))
    return items.withColumn("assets", F.map_concat("assets", more)).drop("band_files")


def conformance(assets: DataFrame, required: Sequence[str], area: Sequence[float] | None = None, least_cover: float = 0.95) -> dict:
    """Scores of flat assets (kind, cloud_cover, timestamp, bbox): must_have 50, clouds 20, dates 20, coverage 10.

    Without a required kind the total is 0. Clouds count for kind s2 if that is required, averaged over
    assets; unknown gives 10. Three dates are enough. Coverage is of the assets' distinct boxes, which a
    catalog search for one area bounds; without an area or boxes it counts as full.
    """
    when = F.col("timestamp").try_cast("timestamp")
    row = assets.agg(F.collect_set("kind").alias("kinds"), F.avg(F.when(F.col("kind") == "s2", F.col("cloud_cover"))).alias("cloud"), F.countDistinct(F.to_date(when)).alias("dates"), F.collect_set("bbox").alias("boxes")).first()
    lacking = [k for k in required if k not in row.kinds]
    if lacking:
        return {"total": 0, "missing_kinds": lacking}
    cloud = 20 if "s2" not in required else 10 if row.cloud is None else 20 if row.cloud < 10 else 10 if row.cloud <= 30 else 0
    cover = covered_share([b for b in row.boxes if b], area) if area and row.boxes else 1.0
    scores = {"must_have": 50, "cloud": cloud, "dates": 20 if row.dates >= 3 else 0, "coverage": 10 if cover >= least_cover else 0}
    return {"total": sum(scores.values()), **scores}


def without(items: DataFrame, gone: DataFrame, keys: Sequence[str] = ("collection", "id")) -> DataFrame:
    """items without those of the keys of gone; with ("collection",) whole collections are deleted."""
    return items.join(gone.select(*keys).distinct(), list(keys), "left_anti")
