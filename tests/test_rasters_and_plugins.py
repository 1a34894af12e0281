import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeflow.functions import geometry
from gaugeflow.operators import catalog, network, raster
from gaugeflow.plans.pipeline import Pipeline, Registry
from gaugeflow.sources import brokers, raster_files
from gaugeflow.sources.settings import Parameter, SettingsError
from pyspark.sql import functions as F


def tiff(image, *, order="<", packed=False, predictor=1, tile=None, nodata=None, place=True):
    """Bytes of a TIFF file of an array (band, row, column), pixel by pixel interleaved."""
    bands, height, width = image.shape
    kind = image.dtype.newbyteorder(order)
    wide, high = tile or (width, 2)
    blocks = []
    for top in range(0, height, high):
        for left in range(0, width, wide):
            rows = high if tile else min(high, height - top)
            block = np.zeros((rows, wide, bands), image.dtype)
            part = image[:, top : top + rows, left : left + wide].transpose(1, 2, 0)
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
            raw = block.astype(kind).tobytes()
            blocks.append(zlib.compress(raw) if packed else raw)
    entries = {256: (4, [width]), 257: (4, [height]), 258: (3, [8 * image.dtype.itemsize] * bands), 259: (3, [8 if packed else 1]), 277: (3, [bands]), 317: (3, [predictor]), 339: (3, [{"u": 1, "i": 2, "f": 3}[image.dtype.kind]] * bands)}
    entries |= {322: (4, [wide]), 323: (4, [high]), 325: (4, [len(b) for b in blocks])} if tile else {278: (4, [high]), 279: (4, [len(b) for b in blocks])}
    if place:
        entries |= {33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0.0, 0.0, 0.0, 500.0, 900.0, 0.0]), 34735: (3, [1, 1, 0, 1, 3072, 0, 1, 32633])}
    if nodata is not None:
        entries[42113] = (2, list(f"{nodata}\0".encode()))
    starts_tag = 324 if tile else 273
    head = 8 + 2 + 12 * (len(entries) + 1) + 4
    letters = {2: "B", 3: "H", 4: "I", 12: "d"}
    extra, starts = b"", []
    for b in blocks:
        starts.append(head + len(extra))
        extra += b
    entries[starts_tag] = (4, starts)
    fields = b""
    for tag, (kind_no, values) in sorted(entries.items()):
        data = struct.pack(order + letters[kind_no] * len(values), *values)
        if len(data) <= 4:
            value = data.ljust(4, b"\0")
        else:
            value = struct.pack(order + "I", head + len(extra))
            extra += data
        fields += struct.pack(order + "HHI", tag, kind_no, len(values)) + value
    return {"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HIH", 42, 8, len(entries)) + fields + b"\0" * 4 + extra


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3), st.integers(1, 7), st.integers(1, 9), st.sampled_from(["uint8", "int16", "uint16", "float32"]), st.sampled_from("<>"), st.booleans(), st.sampled_from([1, 2]), st.sampled_from([None, (4, 3)]))
def test_round_trip(bands, height, width, kind, order, packed, predictor, tile):
    if kind == "float32":
        predictor = 1
    image = np.random.default_rng(height * width).integers(0, 200, (bands, height, width)).astype(kind)
    content = tiff(image, order=order, packed=packed, predictor=predictor, tile=tile)
    assert (raster_files.pixels(content) == image).all()
    meta = raster_files.describe(content)
    assert (meta["width"], meta["height"], meta["bands"], meta["dtype"], meta["epsg"], meta["x0"], meta["dy"]) == (width, height, bands, kind, 32633, 500.0, -10.0)


def test_files_to_rows(spark, tmp_path):
    image = np.arange(12, dtype="int16").reshape(2, 2, 3)
    (tmp_path / "a.tif").write_bytes(tiff(image, nodata=5))
    (tmp_path / "b.tif").write_bytes(b"no tiff")
    rows = {(r.row, r.col): r.bands for r in raster_files.read_pixels(spark, str(tmp_path)).collect()}
    assert rows[0, 0] == [0.0, 6.0]
    assert rows[1, 2] == [None, 11.0]
    errors = {r.path.rsplit("/", 1)[-1]: r.errors for r in raster_files.file_errors(raster_files.read_raster_metadata(spark, str(tmp_path))).collect()}
    assert errors["a.tif"] == [] and "unreadable" in errors["b.tif"]


def test_polygons(spark):
    ring = geometry.polygon_of_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))")
    df = spark.createDataFrame([(0.5, 0.5), (2.0, 2.0), (3.5, 2.0), (9.0, 2.0), (None, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(geometry.in_polygon(F.col("x"), F.col("y"), ring)).collect()]
    assert got[:4] == [True, False, True, False] and not got[4]
    assert geometry.bounds(ring) == (0, 0, 4, 4)
    with pytest.raises(ValueError):
        geometry.polygon_of_wkt("POINT (1 1)")
    row = spark.range(1).select(geometry.epsg_number(F.lit("EPSG:4326")), geometry.linspace(0, 1, 3), geometry.point_wkt(F.lit(1.5), F.lit(2.0))).first()
    assert tuple(row) == (4326, [0.0, 0.5, 1.0], "POINT (1.5 2.0)")


def test_bilinear(spark):
    cells = spark.createDataFrame([(r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "row int, col int, value double")
    points = spark.createDataFrame([(0.5, 0.5), (1.0, 2.0), (1.5, 2.5)], "y double, x double")
    assert {(r.y, r.x): r.value for r in raster.sampled(cells, points).collect()} == {(0.5, 0.5): 5.5, (1.0, 2.0): 12.0, (1.5, 2.5): None}


def test_lines_of_a_growing_file(spark, tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("a\nb\npart")
    spark.dataSource.register(brokers.Broker)
    rows = spark.readStream.format("broker").option("kind", "lines").option("path", str(path)).load()
    query = rows.writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    path.write_text("a\nb\npart two\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.value for r in spark.table("lines").collect()) == ["a", "b", "part two"]


def test_pipelines():
    registry = Registry()
    p = registry.add(Pipeline("p", lambda inputs, values: (inputs, values), [Parameter("days", int, 3)]))
    assert registry.get("p").configure(days=5)(x=1) == ({"x": 1}, {"days": 5})
    for bad in (lambda: registry.add(p), lambda: registry.get("q"), lambda: p.configure(days="x")):
        with pytest.raises(SettingsError):
            bad()


def test_conformance_and_bands(spark):
    box = [14.0, 50.0, 15.0, 51.0]
    data = [("s2", 5.0, f"2025-01-0{i}T00:00:00Z", box) for i in (1, 2, 3)] + [("insitu", None, None, None)]
    schema = "kind string, cloud_cover double, timestamp string, bbox array<double>"
    good = catalog.conformance(spark.createDataFrame(data, schema), ["s2", "insitu"], box)
    assert good["total"] == 100
    assert catalog.conformance(spark.createDataFrame(data[:3], schema), ["s2", "insitu"], box)["total"] == 0
    cloudy = [("s2", 45.0, "2025-01-01T00:00:00Z", [14.0, 50.0, 14.5, 50.5]), data[3]]
    assert catalog.conformance(spark.createDataFrame(cloudy, schema), ["s2", "insitu"], box)["total"] == 50
    items = spark.createDataFrame([("i", {"nir": ("x/a.tif", "image/tiff", ["data"]), "z": ("z", None, None)}, ["t/T33_B02_10m.jp2", "t/readme.txt"])], "id string, assets map<string, struct<href string, type string, roles array<string>>>, band_files array<string>")
    more = catalog.with_band_assets(items, "s3://b/p/").first().assets
    assert more["B02"].href == "s3://b/p/T33_B02_10m.jp2" and set(more) == {"nir", "z", "B02"}
    assert set(catalog.renamed_assets(items, {"nir": "B08"}).first().assets) == {"B08"}
    assert catalog.moved(items, "s3://q").first().assets["nir"].href == "s3://q/a.tif"


def test_network_must_be_connected(spark):
    dates = spark.sql("select explode(array(date'2020-01-01', date'2020-01-13', date'2020-02-01')) as date")
    pairs = spark.sql("select date'2020-01-01' as ref, date'2020-01-13' as rep")
    with pytest.raises(ValueError, match="2020-02-01"):
        network.require_connected(dates, pairs)
    network.require_connected(dates.filter("date < '2020-02-01'"), pairs)
