"""Quality control as a service, task logs, scene selection, acquisition and ingestion."""

import datetime as dt
import json
import time

import numpy as np
import pytest

from gaugeflow.functions import geometry
from gaugeflow.functions.units import read_unit
from gaugeflow.operators import audit, catalog, insar, qc_service
from gaugeflow.plans import ingestion
from gaugeflow.sources import acquisition, brokers, selection, sinks
from gaugeflow.sources.settings import DataError, SettingsError
from pyspark.sql import functions as F

NOW = dt.datetime(2026, 1, 1, 12)


def readings(spark):
    rows = [("good", 1, 7.0), ("good", 2, 7.1), ("bad", 3, 99.0), ("lost", 4, None)]
    return spark.createDataFrame(rows, "source string, id int, ph double")


def test_results_lineage_alerts_and_services(spark, tmp_path):
    given = {"catalog": [], "notification": []}
    services = {n: (lambda rows, n=n: given[n].extend(r.dataset_id for r in rows.collect())) for n in given}
    found = qc_service.process("in_situ", readings(spark), "source", folder=str(tmp_path), when=F.lit(NOW), services=services, key="id")
    assert {r.dataset_id: r.status for r in found.collect()} == {"good": "Pass", "bad": "Fail", "lost": "Warn"}
    assert {r.dataset_id: r.errors for r in found.collect()} == {"good": [], "bad": ["values out of range"], "lost": ["missing values"]}
    assert sorted(given["catalog"]) == ["bad", "good", "lost"] and sorted(given["notification"]) == ["bad", "lost"]
    assert [(r.dataset_id, r.errors) for r in spark.read.parquet(f"{tmp_path}/alerts").collect()] == [("bad", ["values out of range"])]
    records = spark.read.parquet(f"{tmp_path}/lineage")
    assert records.count() == 3 and {r.timestamp for r in records.collect()} == {NOW}
    with pytest.raises(SettingsError):
        qc_service.process("video", readings(spark), "source", folder=str(tmp_path))
    assert qc_service.dispatch(found, {}) == []


def test_review_by_hand(spark, tmp_path):
    qc_service.process("in_situ", readings(spark), "source", folder=str(tmp_path), when=F.lit(NOW), key="id")
    assert qc_service.review(spark, str(tmp_path), "bad", "inspect").count() == 1
    assert [r.status for r in qc_service.review(spark, str(tmp_path), "bad", "override", "Pass").collect()] == ["Pass", "Fail"]
    assert qc_service.review(spark, str(tmp_path), "lost", "re-run").first().status == "Pending"
    states = {r.dataset_id: r.status for r in qc_service.current_status(spark.read.parquet(f"{tmp_path}/lineage")).collect()}
    assert states == {"good": "Pass", "bad": "Pass", "lost": "Pending"}
    for action, status in (("drop", None), ("override", None)):
        with pytest.raises(SettingsError):
            qc_service.review(spark, str(tmp_path), "bad", action, status)


def test_task_log(spark, tmp_path):
    at = iter(NOW + dt.timedelta(seconds=i) for i in range(100))
    with audit.TaskLog(spark, str(tmp_path / "log"), "QCL", "north", "p1", clock=lambda: next(at)) as log:
        log.log("info", "before")
        with log.task("load") as first:
            log.log("warning", "inside")
        with pytest.raises(RuntimeError), log.task("break"):
            raise RuntimeError("no")
        with pytest.raises(ValueError):
            log.task_finished("nothing")
        log.task_started("open")
    rows = audit.read_log(spark, str(tmp_path / "log"))
    assert rows.filter("message = 'inside'").first().task_id == first and rows.filter("message = 'before'").first().task_id is None
    assert {(r.subsystem, r.site, r.project) for r in rows.collect()} == {("QCL", "north", "p1")}
    states = sorted((r.state, r.seconds) for r in audit.task_states(rows).collect())
    assert states == [("failed", 1.0), ("finished", 2.0), ("started", None)]
    with pytest.raises(ValueError):
        audit.TaskLog(spark, "x", "XXX")
    assert audit.subsystems(spark).count() == 11 and audit.levels(spark).count() == 8
    assert audit.seeded(audit.subsystems(spark).limit(0), audit.subsystems(spark)).count() == 11


def test_scene_selection(spark):
    times = [dt.datetime(2025, 1, d, h) for d, h in ((1, 0), (1, 23), (5, 12), (9, 1), (31, 23))]
    scenes = spark.createDataFrame([(t, p) for t, p in zip(times, (7, 7, 3, 3, 9), strict=True)] + [(None, 3)], "datetime timestamp, path int")
    assert selection.processing_window(scenes, "2025-01-01", "2025-01-05").count() == 3
    assert selection.processing_window(scenes).count() == 5
    with pytest.raises(DataError):
        selection.processing_window(scenes, "2025-01-01", "2025-01-01")
    for start, end in (("2025-02-01", "2025-01-01"), ("soon", None)):
        with pytest.raises(SettingsError):
            selection.processing_window(scenes, start, end)
    assert selection.without_dates(scenes, ["2025-01-01"]).count() == 4
    with pytest.raises(DataError):
        selection.without_dates(scenes.filter("path = 9"), ["2025-01-31"])
    with pytest.raises(SettingsError):
        selection.without_dates(scenes, [""])
    assert selection.between(scenes, "2025-01-01T23:00:00Z", "2025-01-09T01:00:00").count() == 3
    assert {r.path for r in selection.on_path(scenes).collect()} == {3} and selection.on_path(scenes, 7).count() == 2
    assert [r.path for r in selection.most_frequent(scenes.filter("path != 3 or datetime is null"), "path").collect()] == [7]
    steps = spark.createDataFrame([(dt.date(2025, 1, 1), 0), (dt.date(2025, 1, 3), 1)], "date date, step int")
    assert selection.require_increasing(steps).count() == 2
    for bad in (steps.withColumn("step", -F.col("step")), steps.union(steps), steps.withColumn("date", F.lit(None).cast("date"))):
        with pytest.raises(DataError):
            selection.require_increasing(bad)
    files = spark.createDataFrame([(f"/s/{d}/T_B0{b}_{d[1:]}.jp2",) for d, b in (("R60m", 1), ("R20m", 2), ("R10m", 2), ("R60m", 2))] + [("/s/T_SCL.tif",), ("/s/readme.txt",)], "path string")
    assert {(r.band, r.path) for r in selection.product_bands(files).collect()} == {("B01", "/s/R60m/T_B01_60m.jp2"), ("B02", "/s/R10m/T_B02_10m.jp2"), ("SCL", "/s/T_SCL.tif")}


def fake(fails=()):
    def search(filters):
        assert filters["start"] == "2025-12-29" and filters["end"] == "2026-01-01" and filters["geom"] == "POINT (0 0)"
        return [(f"{filters['kind']}{i}", NOW, NOW, 5, f"http://x/{i}") for i in (1, 2, 2)]

    def download(url, target):
        if url[-1] in fails:
            raise ValueError("gone")
        return target

    return {"fake": acquisition.Backend("fake", search, download)}


def test_sync_fetches_what_is_missing(spark, tmp_path):
    run = lambda known: {(r.product_id, r.path, r.error) for r in acquisition.sync(spark, [{"backend": "fake", "target_dir": "t", "kind": "a"}], area="POINT (0 0)", root="/r", log=str(tmp_path / "log"), today=dt.date(2026, 1, 1), known=known).collect()}
    assert run(fake("2")) == {("a1", "/r/t/a1", None), ("a2", None, "gone")}
    assert run(fake()) == {("a2", "/r/t/a2", None)}
    assert run(fake()) == set()
    with pytest.raises(SettingsError):
        acquisition.backend("none")
    with pytest.raises(SettingsError):
        acquisition.backend("asf", environment={})
    assert acquisition.target_folder("/r/", "x") == "/r/x" and acquisition.target_folder("/r", "s3://b/x") == "s3://b/x"


def test_ingestion_and_archive(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "piezo_1.csv").write_text("time,pressure (kPa)\n2025-01-01,5\n2025-01-02,6\n")
    (inbox / "notes.txt").write_text("hello\nworld\n")
    (inbox / "gps.xlsx").write_bytes(b"no workbook")
    found = ingestion.ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "done"))
    assert {(r.name, r.state, r.n_lines) for r in found.files.collect()} == {("piezo_1.csv", "loaded", 2), ("notes.txt", "quarantined", 1), ("gps.xlsx", "quarantined", 0)}
    assert sorted(r.cells for r in found.rows.collect()) == [["2025-01-01", "5"], ["2025-01-02", "6"]]
    assert list(inbox.iterdir()) == [] and len(list((tmp_path / "done").iterdir())) == 3
    assert all(r.error is None for r in found.archived.collect())
    again = ingestion.ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "done"))
    assert again.files.count() == 0 and again.rows.count() == 2
    lost = ingestion.archive(spark.createDataFrame([("file:/none/x.csv",)], "path string"), str(tmp_path / "done")).collect()
    assert lost[0].target is None and lost[0].error


def test_defaults_counts_and_imports(spark):
    meta = spark.createDataFrame([("a", None), ("b", "raster")], "id string, type string")
    assert {(r.id, r.type, r.crs) for r in ingestion.with_defaults(meta).collect()} == {("a", "in_situ", "EPSG:4326"), ("b", "raster", "EPSG:4326")}
    checks = ingestion.count_checks(meta, spark.createDataFrame([("a", 1), ("c", 0)], "id string, expected int"), "id")
    assert {(r.id, r.n, r.expected, r.ok) for r in checks.collect()} == {("a", 1, 1, True), ("b", 1, 0, False), ("c", 0, 0, True)}
    kind = "collection string, id string, assets map<string,struct<href:string>>"
    old = spark.createDataFrame([("c", "1", {"data": ("x/1",)}), ("c", "2", {"data": ("x/2",)})], kind)
    new = spark.createDataFrame([("c", "2", {"data": ("y/2n",)}), ("c", "3", {"data": ("y/3",)})], kind)
    published = []
    whole = ingestion.import_items(new, old, "s3://b", publish=lambda df: published.append(df.count()))
    assert {r.id: r.assets["data"].href for r in whole.collect()} == {"1": "x/1", "2": "s3://b/2n", "3": "s3://b/3"} and published == [3]
    more = ingestion.import_items(new, old, "s3://b", append=True, publish=lambda df: published.append(0))
    assert {r.id: r.assets["data"].href for r in more.collect()} == {"1": "x/1", "2": "x/2", "3": "s3://b/3"} and published == [3]
    assert [r.id for r in catalog.without(old, new).collect()] == ["1"] and catalog.without(old, new, ["collection"]).count() == 0


def test_readings_with_sites_as_a_table(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 1.0, 2.0)], "id int, lon double, lat double")
    spark.sql("drop table if exists t_readings")
    assert ingestion.load_readings(df, "t_readings") == 3
    assert {r.id: r.site_id for r in spark.table("t_readings").collect()} == {1: 1, 2: 2, 3: 1}
    spark.sql("drop table t_readings")


def test_item_boxes(spark):
    kind = "id string, collection string, bbox array<double>, properties struct<datetime:string,start_datetime:string,end_datetime:string>"
    boxes = {"ok": [0.0, 0.0, 1.0, 1.0], "six": [0.0, 0.0, 500.0, 1.0, 1.0, 900.0], "far": [0.0, 0.0, 5.0, 1.0, 95.0, 9.0], "five": [0.0] * 5, "none": []}
    items = spark.createDataFrame([(i, "c", b, ("2025-01-01T00:00:00Z", None, None)) for i, b in boxes.items()], kind)
    got = {r.id: r.errors for r in catalog.item_errors(items).collect()}
    assert got == {"ok": [], "six": [], "far": ["bbox outside the world"], "five": ["bbox of another length"], "none": ["no bbox"]}


def test_rings_of_many_edges(spark):
    n = 3000
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    radius = 1 + 0.3 * np.sin(9 * angle)
    ring = [(float(r * np.cos(a)), float(r * np.sin(a))) for r, a in zip(radius, angle, strict=True)]
    random = np.random.default_rng(1)
    points = [(float(x), float(y)) for x, y in random.uniform(-1.4, 1.4, (500, 2))] + [(None, 0.0)]
    df = spark.createDataFrame(points, "x double, y double")
    got = {(r.x, r.y): r.inside for r in df.withColumn("inside", geometry.in_ring(F.col("x"), F.col("y"), ring)).collect()}
    for x, y in points[:-1]:
        wanted = np.hypot(x, y) < 1 + 0.3 * np.sin(9 * np.arctan2(y, x))
        assert got[x, y] == wanted or abs(np.hypot(x, y) - (1 + 0.3 * np.sin(9 * np.arctan2(y, x)))) < 1e-4
    assert got[None, 0.0] is None


def test_long_unit_texts():
    assert read_unit("kPa" + " " * 200, "pressure").common
    assert read_unit("kPa*kPa/kPa*kPa/kPa*kPa/kPa", "pressure").common  # more than 24 letters
    began = time.time()
    assert read_unit("m " * 5000, "level") is None and read_unit("mmmm" * 5000, "level") is None and read_unit("x" * 10**6, "level") is None
    assert time.time() - began < 20


def test_lines_longer_than_a_read(tmp_path):
    path = tmp_path / "lines"
    path.write_bytes(b"x" * 50 + b"\nshort\npart")
    options, got, at = {"path": str(path), "bytes": "10"}, [], {}
    for _ in range(9):
        texts, at = brokers.poll_lines(options, at)
        got += texts
    assert got == ["x" * 50, "short"]


def test_shards_without_records_lose_nothing(monkeypatch):
    records = {"s1": [], "s2": []}

    class Client:
        def list_shards(self, StreamName=None, NextToken=None):
            return {"Shards": [{"ShardId": "s2"}]} if NextToken else {"Shards": [{"ShardId": "s1"}], "NextToken": "t"}

        def get_shard_iterator(self, StreamName, ShardId, ShardIteratorType, StartingSequenceNumber=None, Timestamp=None):
            return {"ShardIterator": (ShardId, ShardIteratorType, StartingSequenceNumber, Timestamp)}

        def get_records(self, ShardIterator, Limit):
            shard, kind, after, since = ShardIterator
            keep = [r for r in records[shard] if (kind == "AFTER_SEQUENCE_NUMBER" and r["SequenceNumber"] > after) or (kind == "AT_TIMESTAMP" and r["t"] >= since)]
            return {"Records": keep[:Limit]}

    monkeypatch.setattr(brokers, "_kinesis", lambda options: Client())
    texts, at = brokers.poll_kinesis({"stream": "x"}, {})
    assert texts == []
    # written between two polls, in both pages of shards
    for shard in records:
        records[shard].append({"Data": shard.encode(), "SequenceNumber": "1", "t": time.time()})
    texts, at = brokers.poll_kinesis({"stream": "x"}, json.loads(json.dumps(at)))
    assert sorted(texts) == ["s1", "s2"]
    assert brokers.poll_kinesis({"stream": "x"}, at)[0] == []


def test_rasters_diagnostics_and_summaries(spark, tmp_path):
    cells = spark.createDataFrame([("2025-01-01", 0, 1, 2.5), ("2025-01-13", 0, 1, float("nan"))], "date string, row int, col int, value double")
    sinks.save_rasters(cells, str(tmp_path / "r"), "los", "mm", tags={"interval": "12"})
    sinks.save_rasters(cells.filter("value = 2.5").withColumn("value", F.lit(9.0)), str(tmp_path / "r"), "los", "mm", tags={"interval": "12"})
    back = {(str(r.date), r.product, r.units, r.tag_interval): r.value for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert back["2025-01-01", "los", "mm", "12"] == 9.0 and len(back) == 2
    sinks.save_diagnostics(cells, str(tmp_path / "d"))
    assert {r.value for r in spark.read.json(str(tmp_path / "d/json")).collect()} == {2.5, None}
    path = sinks.run_summary(str(tmp_path / "runs"), NOW, {"load": "done"}, {"engine": "1"}, ValueError("x"))
    with open(path) as file:
        assert json.load(file) == {"started": NOW.isoformat(), "state": "failed", "stages": {"load": "done"}, "versions": {"engine": "1"}, "failure": "ValueError"}
    sinks.save_manifest(f"file://{tmp_path}/m/x.json", {"a": float("nan")})
    assert json.loads((tmp_path / "m/x.json").read_text()) == {"a": None}
    assert insar.long_rows(spark.createDataFrame([(1, [5.0, 6.0]), (2, None)], "k int, v array<double>"), "v", ["k"]).count() == 2
