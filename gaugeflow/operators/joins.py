"""Joins by nearness, membership and name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import cut


def nearest_location(cells: DataFrame, places: DataFrame, *, most_places: int = 10_000) -> DataFrame:
    """cells (lat, lon) with location: that of the nearest place (location, lat, lon) in squared degrees.

    The place that comes first by name wins a tie; cells without coordinates have none. Up to most_places are
    sent to every task, where each cell looks at all of them; more are found by a search in growing squares.
    """
    places = places.filter("location is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").dropDuplicates(["location"])
    if (n := places.limit(most_places + 1).count()) > most_places:
        return _nearest_by_squares(cells, places)
    listed = places.agg(F.array_sort(F.collect_list(F.struct("location", F.col("lat").alias("y"), F.col("lon").alias("x")))).alias("_places"))
    if n == 0:
        return cells.withColumn("location", F.lit(None).cast("string"))
    ranked = F.transform("_places", lambda p: F.struct((F.pow(p.y - F.col("lat"), 2) + F.pow(p.x - F.col("lon"), 2)).alias("d"), p.location.alias("location")))
    best = F.array_min(F.filter(ranked, lambda r: r.d.isNotNull()))
    return cells.crossJoin(F.broadcast(listed)).withColumn("location", best.location).drop("_places")  # one row


def _nearest_by_squares(cells: DataFrame, places: DataFrame) -> DataFrame:
    """nearest_location for any number of places: equi-joins on squares, twice as wide in each round.

    A place in the three by three squares around a cell is the nearest if it is no farther than a square is wide;
    cells that have none so near go on. Rounds end when a square is wider than all places together.
    """
    rows = cut(cells.withColumn("_id", F.monotonically_increasing_id()))
    asked = rows.filter("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").select("_id", F.col("lat").cast("double").alias("_y"), F.col("lon").cast("double").alias("_x"))
    there = places.select("location", F.col("lat").cast("double").alias("y"), F.col("lon").cast("double").alias("x"))
    n, *box = there.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    mine = asked.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if mine[0] is None:
        return rows.drop("_id").withColumn("location", F.lit(None).cast("string"))
    extent = max(max(box[1], mine[1]) - min(box[0], mine[0]), max(box[3], mine[3]) - min(box[2], mine[2]), 1e-9)
    width, done = max(box[1] - box[0], box[3] - box[2], extent * 1e-9) / max(n**0.5, 1.0), None
    while True:
        square = lambda c, w=width: F.floor(F.col(c) / w)
        around = F.explode(F.array(*[F.struct((square("x") + i).alias("gx"), (square("y") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
        near = asked.withColumns({"gx": square("_x"), "gy": square("_y")}).join(there.select("*", around.alias("_g")).select("location", "x", "y", "_g.*"), ["gx", "gy"])
        far = F.pow(F.col("y") - F.col("_y"), 2) + F.pow(F.col("x") - F.col("_x"), 2)
        best = near.groupBy("_id").agg(F.min(F.struct(far.alias("d"), F.col("location"))).alias("_b"))
        last = width > extent
        found = best.select("_id", "_b.location") if last else best.filter(F.col("_b.d") <= width * width).select("_id", "_b.location")
        found = cut(found)
        done = found if done is None else done.unionByName(found)
        asked = cut(asked.join(found, "_id", "left_anti"))
        if last or not asked.limit(1).count():
            return rows.join(done, "_id", "left").drop("_id")
        width *= 2


def first_location(cells: DataFrame, places: DataFrame) -> DataFrame:
    """cells with location: the first of places, for places without coordinates."""
    return cells.crossJoin(F.broadcast(places.agg(F.min("location").alias("location"))))


def split_by_presence(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of left whose key is in right, the other rows): already seen and new files, present and missing products."""
    keys = right.select(*on).distinct()
    return left.join(keys, list(on), "left_semi"), left.join(keys, list(on), "left_anti")


def lookup_by_pattern(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, name: str) -> DataFrame:
    """left with name: the least right name whose extracted key equals that of the left row, or null."""
    table = right.select(right_key.alias("_k"), F.col(name)).filter("_k != ''").groupBy("_k").agg(F.min(name).alias(name))
    return left.withColumn("_k", left_key).join(table, "_k", "left").drop("_k")


def aligned(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join of tables that must have the same keys; raises if one has a key that the other lacks."""
    lone = left.select(*on).join(right.select(*on), list(on), "left_anti").limit(1).count() + right.select(*on).join(left.select(*on), list(on), "left_anti").limit(1).count()
    if lone:
        raise ValueError("the tables' coordinates differ")
    return left.join(right, list(on))


def site_ids(df: DataFrame, lon: str, lat: str, key: str) -> DataFrame:
    """df with site_id: places numbered from 1 by their least key.

    Distinct places are numbered by a prefix sum over range partitions, not in one window.
    """
    from gaugeflow.operators.shards import running_total

    places = df.groupBy(F.col(lon).alias("_x"), F.col(lat).alias("_y")).agg(F.min(key).alias("_first")).withColumn("_one", F.lit(1))
    numbered = running_total(places, [], ["_first", "_x", "_y"], "_one", "site_id")
    on = df[lon].eqNullSafe(numbered["_x"]) & df[lat].eqNullSafe(numbered["_y"])
    return df.join(numbered, on).select(*[df[c] for c in df.columns], numbered["site_id"].cast("bigint").alias("site_id"))


def union_of_keys(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The different keys that one of the tables has, or both."""
    return left.select(*on).unionByName(right.select(*on)).distinct()
