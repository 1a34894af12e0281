import datetime as dt
import json
import os

import pytest

from gaugeflow.operators.catalog import covered_share
from gaugeflow.sources import detect, remote, settings, sinks, text_files, weather
from gaugeflow.streaming import messages


def test_encodings_in_order():
    assert text_files.decode("°C;mm".encode())[1] == "utf-8"
    assert text_files.decode("测量".encode("gbk")) == ("测量", "gbk")
    assert text_files.decode(b"\xff\xff")[1] == "latin-1"


def test_routes():
    assert detect.route("synthetic_insar_deformation.csv", ["PLATFORM", "DATE", "LATITUDE", "LONGITUDE", "LOS_DEFORMATION (mm)", "QC"])[:2] == ("slope", pytest.approx(0.9))
    assert detect.route("lab.csv", ["pH", "Turbidity", "time"])[0] == "water"
    assert detect.route("notes.txt", ["hello"]) == (None, 0.0, "No parser matched")
    assert detect.route("water.csv", ["a"])[0] is None


def test_files_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("t,X(mm)\n1,2\n3,4\n".encode())
    (tmp_path / "b.csv").write_bytes("t,测量\n5,6\n".encode("gbk"))
    (tmp_path / "c.csv").write_bytes(b"")
    got = {(r.path.rsplit("/", 1)[-1], r.line_no, r.encoding, tuple(r.cells or ()), tuple(r.names)) for r in text_files.read_any_encoding(spark, str(tmp_path)).collect()}
    assert ("b.csv", 1, "gbk", ("5", "6"), ("t", "测量")) in got
    assert len(got) == 3  # Spark passes over empty files
    (tmp_path / "d.xlsx").write_bytes(b"no workbook")
    broken = [r for r in text_files.read_any_encoding(spark, str(tmp_path)).collect() if r.path.endswith("d.xlsx")]
    assert [(r.cells, r.encoding) for r in broken] == [(None, None)]


def test_points_quality_and_times(spark, tmp_path):
    (tmp_path / "p.csv").write_text("time;point;x;y;value\n02.01.2023 12:22:13.317;P;1;2;5.5\n03.01.2023 12:22:13.317;P;3;4;x\n")
    rows = sorted((r.timestamp, r.value, r.x, r.y) for r in text_files.read_points(spark, str(tmp_path / "p.csv")).collect())
    assert rows[0] == (dt.datetime(2023, 1, 2, 12, 22, 13, 317000), 5.5, 3.0, 4.0)
    assert rows[1][1] is None
    wide = spark.createDataFrame([("000",), ("010",), (None,)], "qc string")
    assert [r.qc for r in text_files.with_quality(wide).collect()] == [1, 0, 0]
    narrow = spark.createDataFrame([("0",), ("1",), ("x",), (None,)], "qc string")
    assert [r.qc for r in text_files.with_quality(narrow).collect()] == [0, 1, 1, 1]
    assert text_files.clean_names(["LATITUDE", " Longitude ", "X (mm)", "%"]) == ["lat", "lon", "x_mm", "%"]
    assert text_files.time_column(["a", "Sample Date", "TIME"]) == "TIME"
    timed = text_files.with_instants(spark.createDataFrame([(1, "2023-01-01 00:00:00"), (2, "junk")], "i int, time string"), "i").collect()
    assert [(r.i, r.iso_timestamp) for r in timed] == [(1, "2023-01-01T00:00:00Z")]


def test_remote_and_registry(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hi")
    found = {r.name: (r.content, r.error is None) for r in remote.read_remote(spark, [f"file://{tmp_path}/a.txt", f"file://{tmp_path}/none.txt", "gopher://x/y", "sftp://localhost:1/a"]).collect()}
    assert bytes(found["a.txt"][0]) == b"hi"
    assert not found["none.txt"][1]
    assert remote.bucket_and_key("s3://b/k/x.csv") == ("b", "k/x.csv")
    with pytest.raises(ValueError):
        remote.source("pigeon")
    with pytest.raises(ValueError):
        remote.bucket_and_key("https://b/k")


def test_weather_slices_cache_and_retries(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 29), dt.date(2020, 3, 2))], "start date, end date")
    got = sorted((r.slice_start, r.slice_end) for r in weather.month_slices(df).collect())
    assert got == [(dt.date(2020, 1, 29), dt.date(2020, 1, 31)), (dt.date(2020, 2, 1), dt.date(2020, 2, 29)), (dt.date(2020, 3, 1), dt.date(2020, 3, 2))]
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert weather.with_retries(call, lambda e: isinstance(e, OSError), sleep=waits.append) == "ok"
    assert waits == [2.0, 4.0]
    assert weather.canonical_key({"latitude": 1.000000001, "b": 1}) == weather.canonical_key({"b": 1, "latitude": 1.0})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, p string")
    sinks.save_stage(df, str(tmp_path / "s"), ["i"], {"nan": float("nan")})
    assert sinks.open_stage(spark, str(tmp_path / "s")).count() == 2
    assert json.loads((tmp_path / "s/manifest.json").read_text())["nan"] is None
    assert sinks.open_stage(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        sinks.save_stage(df.union(df), str(tmp_path / "t"), ["i"], {})
    sinks.save_partitions(df, str(tmp_path / "p"), ["p"])
    sinks.save_partitions(spark.createDataFrame([(9, "a")], df.schema), str(tmp_path / "p"), ["p"])
    assert sorted((r.i, r.p) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(2, "b"), (9, "a")]
    (tmp_path / "data.csv").write_text("x")
    sinks.package(str(tmp_path / "z.zip"), {"data.csv": str(tmp_path / "data.csv")}, {"id": "i"})
    item, files = sinks.open_package(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    assert item == {"id": "i"} and [os.path.basename(f) for f in files] == ["data.csv"]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"a": {"b": 1}}')
    assert settings.read_settings(str(tmp_path / "s.json"), ["a.b"]) == {"a": {"b": 1}}
    with pytest.raises(settings.SettingsError):
        settings.read_settings(str(tmp_path / "s.json"), ["a.c"])
    known = [settings.Parameter("days", int, 3), settings.Parameter("name", str, required=True)]
    assert settings.parameters({"name": "x"}, known) == {"days": 3, "name": "x"}
    for bad in ({}, {"name": "x", "days": 1.0}, {"name": "x", "other": 1}):
        with pytest.raises(settings.SettingsError):
            settings.parameters(bad, known)


def test_covered_share():
    assert covered_share([(0, 0, 1, 2), (0.5, 0, 1.5, 1)], (0, 0, 2, 2)) == pytest.approx(2.5 / 4)
    assert covered_share([], (0, 0, 1, 1)) == 0.0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    lines = [json.dumps({"sensor_type": "piezometer", "timestamp": f"2025-01-01T00:{i:02d}:00Z", "pressure_kpa": 1.0 if i % 2 else -1.0, "temperature_c": None}) for i in range(60)]
    lines += ["no json", "[1]", '{"sensor_type": "x"}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(lines[:30]))
    (tmp_path / "in/b.txt").write_text("\n".join(lines[30:]))
    stream = messages.source(spark, {"kind": "files", "path": str(tmp_path / "in"), "files": "1"})
    query = messages.start_pipeline(stream, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    query.awaitTermination()
    good = spark.read.parquet(str(tmp_path / "out/messages")).count()
    bad = {r.status: r["count"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).groupBy("status").count().collect()}
    assert (good, bad) == (31, {"Fail": 30, "Dead": 2})
    assert messages.source(spark, {}) is None
