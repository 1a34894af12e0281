"""Points near other points, and the regions that contain a point.

Containment works by a trapezoidal decomposition: regions are spread over a pyramid of grid cells by their size,
so that none fills more than a few cells, and neighbouring cells are dealt out in shares. In a share the regions'
lower and upper edges cut the plane into ordered slabs, and in a slab its regions' left and right edges into
intervals; a point finds its slab, and its place among the slab's edges, by binary search.

Nearness works on slabs of latitude, cut into cells no narrower than the distance. A place's readings
scatter by a few metres, so points are first gathered into small boxes; most pairs of boxes are surely near
or surely not, and only the rest is settled point by point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.shards import running_total
from gaugeflow.session import cut

EARTH_M = 6371008.8
#: Degrees of a box's side (5.6 m at most) and a bound of the distance from its centre to any point in it.
_BOX_DEG, _BOX_M = 5e-5, 4.0
#: Levels of the pyramid: level L has cells of 360 / 2**L degrees.
_LEVELS = 14


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places on the sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_M)


def located(df: DataFrame, key: str, location: str) -> DataFrame:
    """Distinct (key, lon, lat) of rows with a key and both coordinates, in range and not both 0."""
    rows = df.select(F.col(key).alias("key"), F.col(f"{location}.lon").cast("double").alias("lon"), F.col(f"{location}.lat").cast("double").alias("lat"))
    # NaN is above every number, so the range excludes it
    return rows.filter("key is not null and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)").distinct()


def near_pairs(points: DataFrame, distance_m: float, share: int = 4000) -> DataFrame:
    """(key_a, key_b), key_a < key_b: keys with a point each at most distance_m apart, each pair once.

    points: key, lon, lat, as from located(). All pairs of keys that are near are wanted, so a dense place
    gives as many; points of a key in one box count as one, except where the limit runs through the box.
    A cell with more than share boxes is dealt out: each part of its boxes meets all the boxes that look into
    the cell, so no task holds more than share rows for each of those.
    Nulls don't occur in points; repeated rows change nothing; an empty table gives an empty result.
    """
    reach = distance_m + 2 * _BOX_M
    band_deg = math.degrees(reach / EARTH_M) * (1 + 1e-9)
    x, y = F.floor(F.col("lon") / _BOX_DEG), F.floor(F.col("lat") / _BOX_DEG)
    boxes = points.withColumns({"bx": x, "by": y}).groupBy("key", "bx", "by").agg(*[((F.min(c) + F.max(c)) / 2).alias(c) for c in ("lon", "lat")])

    def cells(band: Column) -> Column:
        """Cells of a slab of latitude: as wide as reach, at the slab's far side of the next slab to the pole."""
        far = F.least(F.greatest(F.abs((band - 1) * band_deg - 90), F.abs((band + 2) * band_deg - 90)), F.lit(90.0))
        return F.greatest(F.floor(F.cos(F.radians(far)) * (360 / band_deg)), F.lit(1))

    def cell(band: Column) -> Column:
        return F.least(F.floor((F.col("lon") + 180) / 360 * cells(band)), cells(band) - 1)

    own = F.floor((F.col("lat") + 90) / band_deg)
    homes = boxes.select(*[F.col(c).alias(f"{c}_b") for c in boxes.columns], own.alias("band"), cell(own).alias("cell"))
    # each pair of cells once: a box looks into its own cell, the next one, and three of the next slab
    steps = ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))
    ahead = F.array_distinct(F.array(*[F.struct((own + i).alias("band"), F.pmod(cell(own + i) + j, cells(own + i)).alias("cell")) for i, j in steps]))
    probes = boxes.select("*", F.explode(ahead).alias("_c")).select("*", "_c.*").drop("_c")
    place = ["band", "cell"]
    # at most one crowded cell for each share boxes
    crowded = homes.groupBy(place).count().filter(F.col("count") > share).select(*place, F.ceil(F.col("count") / share).alias("parts"))
    crowded = cut(crowded)
    if crowded.limit(1).count():
        homes = homes.join(crowded, place, "left").withColumn("part", F.pmod(F.xxhash64("key_b", "bx_b", "by_b"), F.coalesce("parts", F.lit(1)))).drop("parts")
        probes = probes.join(crowded, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        place = [*place, "part"]
    pairs = probes.join(homes, place).filter("key != key_b")
    pairs = pairs.withColumn("_m", great_circle_m(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b"))).filter(F.col("_m") <= reach)
    names = ("key", "bx", "by")
    one, two = F.struct(*names), F.struct(*[F.col(f"{c}_b").alias(c) for c in names])
    first = F.col("key") < F.col("key_b")
    pairs = pairs.select(F.when(first, one).otherwise(two).alias("_1"), F.when(first, two).otherwise(one).alias("_2"), "_m")
    pairs = pairs.select(*[F.col(f"_1.{c}") for c in names], *[F.col(f"_2.{c}").alias(f"{c}_b") for c in names], "_m")
    sure = F.col("_m") <= distance_m - 2 * _BOX_M
    # of two keys' boxes one sure pair is enough: all of them are one row, each other pair of boxes is a row of its own
    boxed = F.when(~sure, F.struct("bx", "by", "bx_b", "by_b"))
    found = cut(pairs.select("key", "key_b", boxed.alias("open")).distinct())
    certain = found.filter("open is null").select("key", "key_b")
    unsure = found.filter("open is not null").join(certain, ["key", "key_b"], "left_anti").select("key", "key_b", "open.*")
    inside = points.withColumns({"bx": x, "by": y})
    other = inside.select(*[F.col(c).alias(f"{c}_b") for c in inside.columns])
    settled = unsure.join(inside, ["key", "bx", "by"]).join(other, ["key_b", "bx_b", "by_b"]).filter(great_circle_m(F.col("lon"), F.col("lat"), F.col("lon_b"), F.col("lat_b")) <= distance_m)
    return certain.unionByName(settled.select("key", "key_b").distinct()).toDF("key_a", "key_b")


def boxes_of(items: DataFrame, key: str, bbox: str) -> DataFrame:
    """Distinct (region, west, south, east, north), west <= east, of the usable boxes of items.

    bbox has four numbers (west, south, east, north), or six (heights third and sixth). A box that crosses
    180 degrees becomes two. Boxes of another length, with nulls or NaN, or south of their south edge, and
    null keys are left out.
    """
    b = F.col("_b")
    flat = F.when(F.size(b) == 4, b).when(F.size(b) == 6, F.array(b[0], b[1], b[3], b[4]))
    rows = items.select(F.col(key).alias("region"), F.col(bbox).cast("array<double>").alias("_b")).withColumn("_b", flat)
    rows = rows.filter("region is not null").select("region", *[F.get("_b", F.lit(i)).alias(c) for i, c in enumerate(("west", "south", "east", "north"))])
    rows = rows.filter("south <= north and not isnan(north) and not isnan(west) and not isnan(east) and west is not null and east is not null")
    east = F.when(F.col("east") > 180, F.col("east") - 360).otherwise(F.col("east"))
    east = F.when(F.col("east") - F.col("west") >= 360, F.lit(180.0)).otherwise(east)
    west = F.when(F.col("east") - F.col("west") >= 360, F.lit(-180.0)).otherwise(F.col("west"))
    rows = rows.withColumns({"west": west, "east": east})
    parts = F.when(F.col("west") <= F.col("east"), F.array(F.struct("west", "east"))).otherwise(
        F.array(F.struct(F.col("west"), F.lit(180.0).alias("east")), F.struct(F.lit(-180.0).alias("west"), F.col("east")))
    )
    return rows.select("region", "south", "north", F.explode(parts).alias("_x")).select("region", "_x.west", "south", "_x.east", "north").distinct()


def _steps(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), first[1], ..."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def _places(edges: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place among ordered edges by binary search: 2 i on edge i, 2 i - 1 before it."""
    above = np.searchsorted(edges, at, "left")
    return np.where(edges[np.minimum(above, len(edges) - 1)] == at, 2 * above, 2 * above - 1)


def locate(x: np.ndarray, y: np.ndarray, west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, region) index pairs, edges included.

    Lower and upper edges cut the plane into slabs, each edge a slab of its own. Slabs are taken from below, with
    the regions that reach through each; only slabs that hold points are cut into intervals, by the left and right
    edges of their regions. Work beyond the searches is in proportion to the regions of such slabs and the pairs.
    """
    edges = np.unique(np.concatenate([south, north]))
    none = np.empty(0, np.int64)
    if not len(edges) or not len(y):
        return none, none
    slab = _places(edges, y)
    order = np.argsort(slab, kind="stable")
    bounds = np.flatnonzero(np.diff(slab[order], prepend=-2))
    low, high = 2 * np.searchsorted(edges, south), 2 * np.searchsorted(edges, north)
    begins, active = np.argsort(low, kind="stable"), none
    starts = low[begins]
    points, regions, begun = [none], [none], 0
    for begin, end in zip(bounds, [*bounds[1:], len(order)], strict=True):
        here, inside = slab[order[begin]], order[begin:end]
        upto = int(np.searchsorted(starts, here, "right"))
        active = np.concatenate([active, begins[begun:upto]])
        active, begun = active[high[active] >= here], upto
        if not len(active):
            continue
        sides = np.unique(np.concatenate([west[active], east[active]]))
        place = _places(sides, x[inside])
        along = np.argsort(place, kind="stable")
        held, starts_at = np.unique(place[along], return_index=True)  # the intervals that hold points
        first, last = np.searchsorted(held, 2 * np.searchsorted(sides, west[active]), "left"), np.searchsorted(held, 2 * np.searchsorted(sides, east[active]), "right")
        n = np.maximum(last - first, 0)
        interval, region = _steps(first, n), np.repeat(active, n)
        many = np.diff([*starts_at, len(along)])[interval]
        points.append(inside[along[_steps(starts_at[interval], many)]])
        regions.append(np.repeat(region, many))
    return np.concatenate(points), np.concatenate(regions)


#: Cells of the pyramid that hold regions (40 bytes each) up to which they are broadcast; more are joined by a shuffle.
_CELLS = 1 << 20


def _morton(x: Column, y: Column) -> Column:
    """Bits of x and y by turns: neighbouring cells have near numbers."""
    z = F.lit(0).cast("bigint")
    for bit in range(_LEVELS + 1):
        for at, c in enumerate((x, y)):
            z = z + F.shiftleft(F.shiftright(c.cast("bigint"), bit).bitwiseAND(1), 2 * bit + at)
    return z


def containing(points: DataFrame, regions: DataFrame, share: int = 4000, load: int = 200_000) -> DataFrame:
    """(key, region): the regions that hold a point of the key, edges included, each pair once.

    points as from located(), regions as from boxes_of(). Cells are dealt out in order of place, in shares of
    about share regions; a cell with more is dealt out over several, each with all of the cell's points, and a
    share with more than load points is cut by points, each part with all of the share's regions. So no task
    holds more, wherever regions or points crowd. Empty tables give an empty result.
    """
    spark = points.sparkSession
    size = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(360 / 2**_LEVELS))
    level = F.least(F.greatest(F.floor(F.log2(360 / size)), F.lit(0)), F.lit(_LEVELS))
    pieces = regions.withColumn("level", level.cast("int"))

    def cell(degrees: Column, level: Column) -> Column:
        return F.floor(degrees * F.pow(F.lit(2.0), level) / 360)

    for a, b, c in (("west", "east", "cx"), ("south", "north", "cy")):
        add = 180 if c == "cx" else 90
        pieces = pieces.withColumn(c, F.explode(F.sequence(cell(F.col(a) + add, F.col("level")), cell(F.col(b) + add, F.col("level")))))
    key = ["level", "cx", "cy"]
    crowds = pieces.groupBy(key).count().withColumn("z", _morton(F.col("cx"), F.col("cy")))
    crowds = running_total(crowds, [], ["level", "z"], "count", "upto")
    crowds = cut(crowds.select(*key, F.floor((F.col("upto") - F.col("count")) / share).alias("deal"), F.ceil(F.col("count") / share).alias("parts")))
    n_cells, levels = crowds.agg(F.count(F.lit(1)), F.collect_set("level")).first()
    if not n_cells:
        return points.select("key", F.lit(None).cast(regions.schema["region"].dataType).alias("region")).limit(0)
    listed = F.broadcast(crowds) if n_cells <= _CELLS else crowds
    # the parts of a crowded cell go to shares that follow one another
    pieces = pieces.join(listed, key).withColumn("deal", F.col("deal") + F.pmod(F.xxhash64("region"), F.col("parts"))).select(*regions.columns, "deal").distinct()
    probes = points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)])))
    probes = probes.withColumns({"cx": cell(F.col("lon") + 180, F.col("level")), "cy": cell(F.col("lat") + 90, F.col("level"))}).join(listed, key)
    probes = probes.withColumn("deal", F.explode(F.sequence("deal", F.col("deal") + F.col("parts") - 1))).select("key", "lon", "lat", "deal")
    # one row for each share whose points are more than one task should hold
    loads = {d: n for d, n in probes.groupBy("deal").count().filter(F.col("count") > load).collect()}
    heavy = F.broadcast(spark.createDataFrame([(d, -(-n // load)) for d, n in loads.items()], "deal bigint, splits bigint"))
    probes = probes.join(heavy, "deal", "left").withColumn("split", F.pmod(F.xxhash64("lon", "lat"), F.coalesce("splits", F.lit(1)))).drop("splits")
    pieces = pieces.join(heavy, "deal", "left").withColumn("split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("splits", F.lit(1)) - 1))).drop("splits")

    def search(p: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        at, of = locate(*[p[c].to_numpy() for c in ("lon", "lat")], *[r[c].to_numpy() for c in ("west", "south", "east", "north")])
        return pd.DataFrame({"key": p["key"].to_numpy(object)[at], "region": r["region"].to_numpy(object)[of]}, dtype=object).drop_duplicates()

    kinds = ", ".join(f"{c} {t.simpleString()}" for c, t in (("key", points.schema["key"].dataType), ("region", regions.schema["region"].dataType)))
    found = probes.groupBy("deal", "split").cogroup(pieces.groupBy("deal", "split")).applyInPandas(search, kinds)
    return found.distinct()
