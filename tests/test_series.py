import datetime as dt
import math

import numpy as np
import pytest

from gaugeflow.functions import scores
from gaugeflow.operators import insar, joins, network, quality, raster, series
from pyspark.sql import functions as F

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_steps_first_is_zero_and_days_at_least_one(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(2), 5.0), ("a", day(3), None), ("b", day(0), 2.0)], "k string, d date, v double")
    got = sorted((r.k, r.d, r.step, r.days, r.velocity) for r in series.steps(df, "v", ["k"], "d").collect())
    assert got == [("a", day(0), 0.0, 1, 0.0), ("a", day(2), 4.0, 2, 2.0), ("a", day(3), 0.0, 1, 0.0), ("b", day(0), 0.0, 1, 0.0)]


def test_nearest_takes_the_earlier_on_a_tie(spark):
    t = lambda s: dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([("a", 1, t(10)), ("a", 2, t(99)), ("b", 3, t(0)), ("a", 4, None)], "k string, i int, ts timestamp")
    right = spark.createDataFrame([("a", t(0), 1.0), ("a", t(20), 2.0)], "k string, at timestamp, v double")
    near = series.nearest(left, right, keys=["k"], when="ts", right_when="at", values=["v"])
    assert {r.i: r.nearest_v for r in near.collect()} == {1: 1.0, 2: 2.0, 3: None, 4: None}
    close = series.nearest(left, right, keys=["k"], when="ts", right_when="at", values=["v"], tolerance_s=15)
    assert {r.i: r.nearest_v for r in close.collect()} == {1: 1.0, 2: None, 3: None, 4: None}
    line = series.interpolated(left, right, keys=["k"], when="ts", right_when="at", value="v")
    assert {r.i: r.linear_v for r in line.collect()} == {1: 1.5, 2: None, 3: None, 4: None}


def test_rolling_of_ones(spark):
    df = spark.range(10).selectExpr("'x' as k", "id", "1.0D as v")
    assert max(r.s for r in df.withColumn("s", series.rolling(F.col("v"), 7, ["k"], ["id"])).collect()) == 7
    assert max(r.s for r in series.rolling_blocks(df, "v", 7, ["k"], ["id"], "s", block_rows=12).collect()) == 7


def test_scores(spark):
    row = spark.range(1).select(
        scores.us_aqi(F.lit(12.0)), scores.us_aqi(F.lit(12.05)), scores.us_aqi(F.lit(None).cast("double")), scores.risk_class(F.lit(None).cast("double")), scores.risk_class(F.lit(60.0)),
        scores.linear_score(F.lit(None).cast("double"), 0, 1), scores.spectral_angle(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))), scores.spectral_angle(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))),
    ).first()
    assert row[0] == 50.0
    assert row[1] == pytest.approx((49 / 23.3) * -0.05 + 51)
    assert row[2:6] == (200.0, "Low", "High", None)
    assert row[6] == pytest.approx(math.pi / 2)
    assert row[7] == 0.0


def test_utm_of_known_points(spark):
    east, north = scores.utm_coordinates(F.lit(0.0), F.lit(3.0), F.lit(31))
    row = spark.range(1).select(east, north).first()
    assert row[0] == pytest.approx(500000, abs=0.01)
    assert row[1] == pytest.approx(0, abs=0.01)
    # the scale on the central meridian: a quarter meridian is 10001965.729 m
    north_pole = spark.range(1).select(scores.utm_coordinates(F.lit(89.999999), F.lit(3.0), F.lit(31))[1]).first()[0]
    assert north_pole == pytest.approx(10001965.729 * 0.9996, abs=1)


def test_quality_golden(spark):
    df = spark.createDataFrame([("d", 1, 7.0, 10.0), ("d", 2, 15.5, 10.0), ("e", 1, 7.0, 10.0), ("e", 1, 7.0, 10.0), ("f", 1, 7.0, float("nan")), ("g", 1, 7.0, 1.0)], "ds string, id int, ph double, temperature double")
    got = {r.ds: r.status for r in quality.check_readings(df, "ds", key="id").collect()}
    assert got == {"d": "Fail", "e": "Fail", "f": "Warn", "g": "Pass"}
    office = spark.createDataFrame([("a", 0, "x OFFICE", 99.0), ("b", 0, None, 7.0), ("c", 1, "OFFICE", 7.0)], "ds string, qc int, platform string, ph double")
    assert {r.ds: r.status for r in quality.check_readings(office, "ds", qc="qc", platform="platform").collect()} == {"a": "Warn", "b": "Fail", "c": "Pass"}


def test_scene_quality_golden(spark):
    keys = ["crs", "cloud_cover_pct", "sensor_type"]
    data = [(1, 0.05, True, "optical", 40.0, keys), (2, 0.0, True, "optical", 40.0, ["crs"]), (3, 0.05, True, "optical", 40.0, ["crs"]), (4, 0.0, True, "hyperspectral", 10.0, keys), (5, 0.0, True, "optical", 40.0, keys)]
    df = spark.createDataFrame(data, "i int, null_pixel_pct double, is_geometrically_aligned boolean, sensor_type string, snr double, metadata_keys array<string>")
    assert {r.i: r.status for r in quality.check_scenes(df).collect()} == {1: "Fail", 2: "Warn", 3: "Warn", 4: "Fail", 5: "Pass"}
    assert {r.i: r.status for r in quality.check_scenes(df, strict=True).collect()}[3] == "Fail"


def test_reference_offset_golden(spark):
    schema = "pair string, phase double, corr double, comp int"
    even = spark.createDataFrame([("p", 1.0, 0.5, 1), ("p", 2.0, 0.5, 1), ("p", 4.0, 0.5, 1), ("p", 8.0, 0.5, 1), ("p", 100.0, 0.9, 2), ("p", float("nan"), 0.9, 1)], schema)
    r = insar.reference_offsets(even).first()
    assert (r["offset"], r["component"], r["pixels"]) == (3.0, 1, 4)
    heavy = spark.createDataFrame([("p", 1.0, 0.1, 1), ("p", 6.0, 0.9, 1), ("p", 7.0, 0.1, 1)], schema)
    assert insar.reference_offsets(heavy).first()["offset"] == 6.0


def test_network_solution_golden(spark):
    d = [day(0), day(12), day(24)]
    schema = "y int, x int, ref date, rep date, phase double, corr double"
    pixels = spark.createDataFrame([(0, 0, d[0], d[1], 1.0, 0.8), (0, 0, d[1], d[2], 2.0, 0.8), (0, 1, d[0], d[1], 1.0, 0.8), (0, 1, d[1], d[2], None, 0.8), (0, 2, d[1], d[2], 1.0, 0.8)], schema)
    found = insar.solve_network(pixels, -4.4)
    got = {(r.x, r.date): r.los_mm for r in found.collect()}
    assert [got[0, t] for t in d] == pytest.approx([0, -4.4, -13.2])
    assert got[1, d[1]] == pytest.approx(-4.4)
    assert all(v is None or math.isnan(v) for v in (got[1, d[2]], *(got[2, t] for t in d)))
    speed = insar.velocities(found.filter("x = 0"), "los_mm", "date", ["x"]).first().mm_per_year
    assert speed == pytest.approx(-13.2 / 24 * 365.25)
    last = series.intervals(found.filter("x = 0"), "los_mm", ["x"], "date").orderBy("end").collect()[-1]
    assert (last.change, last.rate) == (pytest.approx(-8.8), pytest.approx(-8.8 / 12))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), *range(100, 120), 200]], "node int")
    got = {r.node: r.component for r in network.components(nodes, spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {200: 200}


PAIR = "ref date, rep date, baseline double, duration int, pair string"


def test_repair_golden(spark):
    days = [dt.date(2026, 1, 1), dt.date(2026, 1, 13), dt.date(2026, 6, 1)]
    dates = spark.createDataFrame([(d,) for d in [*days, days[0], None]], "date date")
    pairs = spark.createDataFrame([(days[0], days[1], 10.0, 12, "a b")], PAIR)
    more = spark.createDataFrame([(days[1], days[2], 60.0, 139, "b c"), (days[0], days[2], 90.0, 151, "a c")], PAIR)
    repaired = lambda **k: [[tuple(r) for r in df.collect()] for df in network.repair(dates, pairs, more, max_days=36, max_metres=80, **k)]
    whole, added, dropped = repaired()
    assert (len(whole), [r[4] for r in added], dropped) == (2, ["b c"], [])
    whole, added, dropped = repaired(max_bridge=50, max_dropped=0.5)
    assert (len(whole), added, dropped) == (1, [], [(days[2],)])
    with pytest.raises(ValueError):
        network.repair(dates, pairs, more, max_days=36, max_metres=80, max_bridge=50)
    none = [df.count() for df in network.repair(dates.limit(0), pairs.limit(0), more.limit(0), max_days=36, max_metres=80)]
    assert none == [0, 0, 0]


def test_bridges_are_those_of_one_at_a_time(spark):
    """Random networks against the cheapest-first choice, one pair after the other, with ties in cost."""
    random = np.random.default_rng(3)
    for _ in range(3):
        days = [dt.date(2026, 1, 1) + dt.timedelta(days=int(i) * 12) for i in range(24)]
        every = [(a, b, float(random.integers(-5, 6)) * 40, (b - a).days, f"{a} {b}") for i, a in enumerate(days) for b in days[i + 1 :]]
        pairs, more = every[::23], every
        group = {d: d for d in days}
        def merge(a, b):
            x, y = group[a], group[b]
            for d in days:
                group[d] = x if group[d] == y else group[d]
            return x != y
        for r in pairs:
            merge(r[0], r[1])
        wanted = [r[4] for r in sorted(more, key=lambda r: (r[3] / 36 + abs(r[2]) / 80, r[0], r[1])) if abs(r[2]) <= 160 and merge(r[0], r[1])]
        found = network.bridges(spark.createDataFrame([(d,) for d in days], "date date"), spark.createDataFrame(pairs, PAIR), spark.createDataFrame(more, PAIR), max_days=36, max_metres=80, max_bridge=160)
        assert sorted(r.pair for r in found.collect()) == sorted(wanted)


def test_components_of_a_range(spark):
    """Edges and nodes of one plan with column statistics; a chain longer than any number of rounds."""
    r = spark.range(400)
    found = network.components(r.select(F.col("id").alias("node")), r.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("b < 400"))
    assert [tuple(x) for x in found.groupBy("component").count().collect()] == [(0, 400)]


def test_labels_by_size(spark):
    cells = [(0, c) for c in range(5)] + [(2, c) for c in range(4)] + [(3, 3), (3, 4), (5, 0), (4, 9)]
    got = {(r.row, r.col): r.label for r in raster.labelled(spark.createDataFrame(cells, "row int, col int")).collect()}
    assert {got[2, 0], got[3, 4]} == {1}
    assert got[0, 4] == 2
    assert (5, 0) not in got


def test_nearest_location_of_few_and_many_places(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, None, 1.0)], "i int, lat double, lon double")
    places = spark.createDataFrame([("b", 0.0, 1.0), ("a", 0.0, -1.0), ("c", 10.0, 10.0)], "location string, lat double, lon double")
    assert {r.i: r.location for r in joins.nearest_location(cells, places).collect()} == {1: "a", 2: "c", 3: None}
    assert {r.i: r.location for r in joins.nearest_location(cells, places, most_places=2).collect()} == {1: "a", 2: "c", 3: None}
    random = np.random.default_rng(2)
    at = [(i, float(y), float(x)) for i, (y, x) in enumerate(random.normal(0, 1, (300, 2)) * random.choice([0.01, 5.0], (300, 1)))]
    there = [(f"p{i:03d}", float(y), float(x)) for i, (y, x) in enumerate(random.normal(0, 1, (200, 2)) * random.choice([0.01, 3.0], (200, 1)))]
    some, every = spark.createDataFrame(at, "i int, lat double, lon double"), spark.createDataFrame(there, "location string, lat double, lon double")
    brute = {i: min(((v - y) ** 2 + (u - x) ** 2, n) for n, v, u in there)[1] for i, y, x in at}
    assert {r.i: r.location for r in joins.nearest_location(some, every, most_places=10).collect()} == brute == {r.i: r.location for r in joins.nearest_location(some, every).collect()}
    with pytest.raises(ValueError):
        joins.aligned(cells, cells.filter("i < 3"), ["i"])


def test_carried_over_blocks_and_clashing_names(spark):
    """Known values carried over blocks without any, in two series with names that the operator uses itself."""
    from gaugeflow.operators.shards import carried

    values = [None, 1.0] + [None] * 20 + [2.0, None]
    rows = [(k, i, v, "x", 7) for k in ("a", None) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "block string, pos int, _v double, _whole string, core int")
    got = {(r.block, r.pos): (r.b, r.a) for r in carried(df, ["block"], ["pos"], "_v", "b", "a", block_rows=4).collect()}
    for k in ("a", None):
        assert got[k, 0] == (None, 1.0) and got[k, 1] == (1.0, 1.0) and got[k, 10] == (1.0, 2.0) and got[k, 23] == (2.0, None)
    assert carried(df.limit(0), ["block"], ["pos"], "_v", "b", "a").count() == 0


def test_accelerations(spark):
    df = spark.createDataFrame([("a", day(0), 0.0), ("a", day(2), 4.0), ("a", day(3), 9.0), ("b", day(0), 1.0)], "k string, d date, v double")
    got = {(r.k, r.d): (r.rate, r.acceleration) for r in series.accelerations(df, "v", ["k"], "d").collect()}
    assert got == {("a", day(0)): (None, None), ("a", day(2)): (2.0, None), ("a", day(3)): (5.0, 3.0), ("b", day(0)): (None, None)}
