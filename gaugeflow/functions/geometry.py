"""Plane geometry as column expressions: rings of coordinates, WKT, affine transforms."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many edges are terms of one generated expression; longer rings are searched by a vectorized function.
MOST_EDGES = 2000
#: Points and edges that are compared at a time.
_AT_ONCE = 1 << 22


def in_ring(x: Column, y: Column, ring: Sequence[Sequence[float]]) -> Column:
    """Whether a point lies in a ring (first and last vertex may be equal), by crossings; null for null."""
    edges = [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]], strict=True) if tuple(a[:2]) != tuple(b[:2])]
    if len(edges) > MOST_EDGES:
        return _in_long_ring(edges)(x.cast("double"), y.cast("double"))
    crossings = []
    for (x1, y1, *_), (x2, y2, *_) in edges:
        if y1 != y2:
            side = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
            crossings.append((side & (x < (y - float(y1)) * ((x2 - x1) / (y2 - y1)) + float(x1))).cast("int"))
    if not crossings:
        return F.lit(False)
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def _in_long_ring(edges: Sequence[tuple[Sequence[float], Sequence[float]]]):
    """Arrow function (x, y) -> inside, by the same crossings: points in order of y meet only the edges that reach theirs."""
    ends = np.array([(a[0], a[1], b[0], b[1]) for a, b in edges if a[1] != b[1]], float)
    low, high = np.minimum(ends[:, 1], ends[:, 3]), np.maximum(ends[:, 1], ends[:, 3])

    def inside(xs: pd.Series, ys: pd.Series) -> pd.Series:
        known = (xs.notna() & ys.notna()).to_numpy()
        order = np.flatnonzero(known)[np.argsort(ys.to_numpy()[known], kind="stable")]
        px, py = xs.to_numpy()[order], ys.to_numpy()[order]
        count = np.zeros(len(order), np.int64)
        # an edge reaches points from its low end to before its high end
        first, last = np.searchsorted(py, low, "left"), np.searchsorted(py, high, "left")
        n = last - first
        cuts = np.searchsorted(np.cumsum(n), np.arange(0, n.sum() + _AT_ONCE, _AT_ONCE))
        for begin, end in zip(cuts[:-1], [*cuts[1:-1], len(n)], strict=True):
            some = n[begin:end]
            at = np.repeat(first[begin:end] - np.concatenate([[0], np.cumsum(some)[:-1]]), some) + np.arange(some.sum())
            x1, y1, x2, y2 = np.repeat(ends[begin:end], some, axis=0).T
            np.add.at(count, at, px[at] < (py[at] - y1) * ((x2 - x1) / (y2 - y1)) + x1)
        out = np.full(len(xs), None, object)
        out[order] = count % 2 == 1
        return pd.Series(out, dtype=object)

    return F.pandas_udf(inside, "boolean")


def in_polygon(x: Column, y: Column, rings: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Inside the first ring and outside the others, after a test against the first ring's box."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    near = x.between(float(min(xs)), float(max(xs))) & y.between(float(min(ys)), float(max(ys)))
    inside = in_ring(x, y, rings[0])
    for hole in rings[1:]:
        inside = inside & ~in_ring(x, y, hole)
    return F.when(near, inside).otherwise(near)


def polygon_of_wkt(text: str) -> list[list[tuple[float, float]]]:
    """Rings of a POLYGON text."""
    found = re.match(r"^\s*POLYGON\s*(?:Z\s*)?\((.*)\)\s*$", text, re.I | re.S)
    if not found:
        raise ValueError("not a polygon")
    return [[(float(a), float(b)) for a, b, *_ in (p.split() for p in ring.split(","))] for ring in re.findall(r"\(([^()]*)\)", found[1])]


def bounds(rings: Sequence[Sequence[Sequence[float]]]) -> tuple[float, float, float, float]:
    """(west, south, east, north) of the first ring."""
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return min(xs), min(ys), max(xs), max(ys)


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")")))


def epsg_number(text: Column) -> Column:
    """The number of an EPSG:n text."""
    return F.regexp_extract(text, r"(?i)^\s*EPSG:(\d+)\s*$", 1).try_cast("int")


def linspace(low: float, high: float, n: int) -> Column:
    """Array of n evenly spaced numbers, both ends included."""
    if n < 2:
        return F.array(F.lit(float(low)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lit(float(low)) + i * ((high - low) / (n - 1)))
