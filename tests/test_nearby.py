import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.operators.nearby import EARTH_M, boxes_of, containing, locate, located, near_pairs

POINT = "platform string, location struct<lon double, lat double>, key string, region string"
ITEM = "id string, bbox array<double>, key string"


def points(spark, data):
    return located(spark.createDataFrame([(k, p, "x", "y") for k, p in data], POINT), "platform", "location")


def regions(spark, data):
    return boxes_of(spark.createDataFrame([(i, b, "x") for i, b in data], ITEM), "id", "bbox")


DIRTY = [("N", None), ("N", (None, 1.0)), ("N", (1.0, None)), ("N", (0.0, 0.0)), ("N", (float("nan"), 1.0)), ("N", (200.0, 1.0)), (None, (10.0, 10.0))]


def brute_near(data, metres):
    good = [(k, *p) for k, p in data if k is not None and p is not None and None not in p and not any(np.isnan(p)) and p != (0.0, 0.0) and abs(p[0]) <= 180]
    out = set()
    for a, x, y in good:
        for b, u, v in good:
            h = np.sin(np.radians(v - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(v)) * np.sin(np.radians(u - x) / 2) ** 2
            if a < b and 2 * EARTH_M * np.arcsin(np.sqrt(h)) <= metres:
                out.add((a, b))
    return out


@pytest.mark.parametrize("lat", [0.0, 60.0, -89.9995])
def test_near_matches_brute_force(spark, lat):
    random = np.random.default_rng(3)
    data = [(f"P{i:02d}", (float(lon), float(np.clip(lat + random.normal(0, 0.003), -90, 90)))) for i in range(40) for lon in ((random.choice([179.999, -179.999, 10.0]) + random.normal(0, 0.004) + 540) % 360 - 180,) for _ in range(3)]
    got = [(r.key_a, r.key_b) for r in near_pairs(points(spark, data + DIRTY), 250.0).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_near(data, 250.0)


def test_near_settles_boxes_at_the_limit(spark):
    step = float(np.degrees(250 / EARTH_M))
    data = [("A", (10.0, 50.0)), ("B", (10.0, 50.0 + step * 0.999)), ("C", (10.0, 50.0 - step * 1.001)), ("A", (10.0, 50.00001))]
    got = {(r.key_a, r.key_b) for r in near_pairs(points(spark, data), 250.0).collect()}
    assert got == brute_near(data, 250.0) == {("A", "B")}


def test_within(spark):
    data = [("A", (10.0, 50.0)), ("A", (10.0, 50.0)), ("B", (179.99, 0.5)), ("C", (-179.99, 0.5)), *DIRTY]
    boxes = [
        ("edge", [10.0, 50.0, 11.0, 51.0]), ("six", [9.0, 49.0, -5.0, 10.5, 50.5, 5.0]), ("cross", [179.0, 0.0, -179.0, 1.0]), ("over", [179.5, 0.0, 181.0, 1.0]),
        ("world", [-180.0, -90.0, 180.0, 90.0]), ("none", None), ("empty", []), ("five", [1.0, 2.0, 3.0, 4.0, 5.0]), ("nulls", [None, 0.0, 1.0, 1.0]),
        ("nan", [float("nan"), 0.0, 20.0, 60.0]), ("upside", [0.0, 60.0, 20.0, 40.0]), (None, [0.0, 0.0, 50.0, 60.0]), ("six", [9.0, 49.0, -5.0, 10.5, 50.5, 5.0]),
    ]
    got = sorted((r.key, r.region) for r in containing(points(spark, data), regions(spark, boxes)).collect())
    assert got == [("A", "edge"), ("A", "six"), ("A", "world"), ("B", "cross"), ("B", "over"), ("B", "world"), ("C", "cross"), ("C", "over"), ("C", "world")]


def test_crowded_cells_are_split(spark):
    random = np.random.default_rng(5)
    data = [(f"P{i}", (float(x), float(y))) for i, (x, y) in enumerate(random.uniform(20, 20.02, (60, 2)))]
    boxes = [(f"R{i}", [float(x), float(y), float(x + 0.01), float(y + 0.01)]) for i, (x, y) in enumerate(random.uniform(20, 20.01, (50, 2)))]
    got = [(r.key, r.region) for r in containing(points(spark, data), regions(spark, boxes), share=7, load=10).collect()]
    expected = {(k, r) for k, (x, y) in data for r, (w, s, e, n) in boxes if w <= x <= e and s <= y <= n}
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_empty(spark):
    none, some = points(spark, []), regions(spark, [("a", [0.0, 0.0, 1.0, 1.0])])
    assert containing(none, some).count() == 0
    assert containing(points(spark, [("A", (1.0, 1.0))]), regions(spark, [])).count() == 0
    assert near_pairs(none, 250.0).count() == 0


grid = st.integers(0, 6).map(float)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(grid, grid), max_size=12), st.lists(st.tuples(grid, grid, grid, grid), max_size=10))
def test_locate_on_shared_edges(places, boxes):
    boxes = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in boxes]
    x, y = (np.array([p[i] for p in places]) for i in (0, 1))
    edges = [np.array([b[i] for b in boxes]) for i in range(4)]
    p, r = locate(x, y, *edges)
    assert sorted(zip(p.tolist(), r.tolist(), strict=True)) == [(i, j) for i, (u, v) in enumerate(places) for j, (w, s, e, n) in enumerate(boxes) if w <= u <= e and s <= v <= n]


def test_crowded_cells_of_near_places_are_dealt_out(spark):
    """All places in a few cells; each reading has a box of its own, and parts hold at most 30 of them."""
    random = np.random.default_rng(7)
    data = [(f"P{i % 40:02d}", (float(30 + x), float(10 + y))) for i, (x, y) in enumerate(random.uniform(0, 0.004, (1200, 2)))]
    far = [(f"Q{i}", (float(30 + 0.01 * i), 10.02)) for i in range(20)]
    got = [(r.key_a, r.key_b) for r in near_pairs(points(spark, data + far), 250.0, share=30).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(r.key_a, r.key_b) for r in near_pairs(points(spark, data + far), 250.0).collect()} == brute_near(data + far, 250.0)


def test_shares_of_many_levels(spark):
    """Regions of all sizes over the whole world, in shares of ten."""
    random = np.random.default_rng(9)
    data = [(f"P{i}", (float(x), float(y))) for i, (x, y) in enumerate(zip(random.uniform(-180, 180, 300), random.uniform(-90, 90, 300), strict=True))]
    boxes = []
    for i in range(200):
        w, s, size = random.uniform(-180, 170), random.uniform(-90, 80), 10 ** random.uniform(-3, 1.5)
        boxes.append((f"R{i}", [float(w), float(s), float(min(w + size, 180)), float(min(s + size / 2, 90))]))
    got = {(r.key, r.region) for r in containing(points(spark, data), regions(spark, boxes), share=10, load=50).collect()}
    assert got == {(k, r) for k, (x, y) in data for r, (w, s, e, n) in boxes if w <= x <= e and s <= y <= n}
