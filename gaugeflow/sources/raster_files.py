"""GeoTIFF files without external libraries: their description, and their pixels as rows.

Reads plain and deflate-compressed files in strips or tiles, with the horizontal predictor, of integers and
floats; others get an error text instead of pixels.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Field types of TIFF, as (size, struct letter).
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIE, GEO, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
_KINDS = {1: "u", 2: "i", 3: "f"}
META = "path string, width int, height int, bands int, dtype string, nodata double, epsg int, x0 double, dx double, y0 double, dy double, error string"


def tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags) of the first image of a file."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", content[4:8])
    (n,) = struct.unpack(order + "H", content[at : at + 2])
    found: dict[int, tuple] = {}
    for i in range(n):
        entry = content[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        size, letter = _TYPES[kind]
        where = 0 if size * count <= 4 else struct.unpack(order + "I", entry[8:12])[0]
        data = entry[8 : 8 + size * count] if size * count <= 4 else content[where : where + size * count]
        found[tag] = (data.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + letter * count, data)
    return order, found


def describe(content: bytes) -> dict:
    """Size, bands, type, nodata, EPSG code and the transform of the upper left corner."""
    _, t = tags(content)
    kind = _KINDS.get(t.get(FORMAT, (1,))[0], "u") + str(t.get(BITS, (8,))[0] // 8)
    keys = t.get(GEO, ())
    epsg = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048) and keys[i + 1] == 0), None)
    scale, tie = t.get(SCALE), t.get(TIE)
    placed = {"x0": None, "dx": None, "y0": None, "dy": None}
    if scale and tie:
        placed = {"x0": tie[3] - tie[0] * scale[0], "dx": scale[0], "y0": tie[4] + tie[1] * scale[1], "dy": -scale[1]}
    nodata = t.get(NODATA, (None,))[0]
    return {"width": t[WIDTH][0], "height": t[HEIGHT][0], "bands": t.get(SAMPLES, (1,))[0], "dtype": str(np.dtype(kind)), "nodata": float(nodata) if nodata else None, "epsg": epsg, **placed}


def pixels(content: bytes) -> np.ndarray:
    """The image as (band, row, column)."""
    order, t = tags(content)
    width, height, bands = t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0]
    kind = np.dtype(order + _KINDS.get(t.get(FORMAT, (1,))[0], "u") + str(t.get(BITS, (8,))[0] // 8))
    packing, predictor, planar = t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0], t.get(PLANAR, (1,))[0]
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {packing} with predictor {predictor} can't be read")
    tiled = TILES in t
    wide, high = (t[TILE_WIDTH][0], t[TILE_HEIGHT][0]) if tiled else (width, min(t.get(ROWS, (height,))[0], height))
    starts, sizes = (t[TILES], t[TILE_BYTES]) if tiled else (t[STRIPS], t[STRIP_BYTES])
    across, down = -(-width // wide), -(-height // high)
    deep = bands if planar == 1 else 1
    out = np.zeros((bands, height, width), kind.newbyteorder("="))
    for k, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        raw = content[start : start + size]
        raw = zlib.decompress(raw) if packing != 1 else raw
        plane, place = divmod(k, across * down)
        row, col = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - row)
        block = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        part = block[: height - row, : width - col].transpose(2, 0, 1)
        first = 0 if planar == 1 else plane
        out[first : first + deep, row : row + part.shape[1], col : col + part.shape[2]] = part
    return out


def read_raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file; error is null if it can be read."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows.append({"path": name, **describe(bytes(content)), "error": None})
                except (ValueError, KeyError, struct.error) as error:
                    rows.append({"path": name, "error": str(error) or "broken"})
            names = [c.split()[0] for c in META.split(", ")]
            yield pd.DataFrame({n: [row.get(n) for row in rows] for n in names}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, META)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, bands): one row for each pixel, its bands as doubles; nodata and NaN are null.

    A file is decoded in one task and sent on in pieces of some rows of pixels; files that can't be read
    give none, see read_raster_metadata().
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                try:
                    nodata, image = describe(bytes(content))["nodata"], pixels(bytes(content))
                except (ValueError, KeyError, struct.error, zlib.error):
                    continue
                step = max(1, 100_000 // max(image.shape[2], 1))
                for top in range(0, image.shape[1], step):
                    some = image[:, top : top + step].astype(float)
                    some[(some == nodata) | np.isnan(some)] = np.nan
                    flat = some.reshape(len(some), -1).T
                    row, col = np.divmod(np.arange(len(flat)), image.shape[2])
                    yield pd.DataFrame({"path": name, "row": row + top, "col": col, "bands": [[None if v != v else v for v in p] for p in flat.tolist()]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row int, col int, bands array<double>")


def file_errors(metadata: DataFrame) -> DataFrame:
    """(path, errors) of files: unreadable, without size or bands, without place or reference system."""
    from pyspark.sql import functions as F

    tests = {"unreadable": F.col("error").isNotNull(), "no size": F.coalesce(F.col("width") * F.col("height"), F.lit(0)) == 0, "no bands": F.coalesce("bands", F.lit(0)) == 0, "no place": F.col("x0").isNull(), "no reference system": F.col("epsg").isNull()}
    return metadata.select("path", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).alias("errors"))
