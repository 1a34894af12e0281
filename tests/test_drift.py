import datetime as dt

import pytest

from gaugeflow.operators.drift import column_changes, column_lifespans, footer_columns, one_table, typed_cells

FILE = "file_id bigint, feed string, period_start date, name string"
HEAD = "file_id bigint, ordinal int, name string, type string, feed string"
DAY = dt.date(2025, 1, 1)


def frames(spark, heads, order=None):
    files = [(i, "F", DAY + dt.timedelta(days=(order or {}).get(i, i)), "x") for i in heads]
    rows = [(i, n + 1, c, t, "x") for i, cols in heads.items() for n, (c, t) in enumerate(cols)]
    return spark.createDataFrame(files, FILE), spark.createDataFrame(rows, HEAD)


HEADS = {
    1: [("Platform", "text"), ("pressure kPa", "number"), ("snr", "number")],
    2: [("PLATFORM", "TEXT"), ("Druck [psi]", "number"), ("snr", "integer")],
    3: [("snr", "integer"), ("platform", "text"), ("druck_psi", "text"), ("qc", "number")],
    4: [("platform", "text"), ("presion", "number")],
    5: [("platform", "text"), ("presion", "number"), ("snr", "integer")],
}
CHANGES = {
    (2, "renamed", "pressure_kpa", "druck_psi"), (2, "retyped", "snr", "snr"), (3, "retyped", "druck_psi", "druck_psi"), (3, "added", "", "qc"),
    (4, "renamed", "druck_psi", "presion"), (4, "retyped", "druck_psi", "presion"), (4, "removed", "snr", ""), (4, "removed", "qc", ""), (5, "added", "", "snr"),
}


@pytest.mark.parametrize("block", [4, 5, 50_000])
def test_changes(spark, block):
    files, heads = frames(spark, HEADS)
    got = [tuple(r) for r in column_changes(files.unionByName(files), heads.unionByName(heads), block_files=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == CHANGES


def test_late_files_and_other_feeds(spark):
    files, heads = frames(spark, {1: [("a", "text")], 2: [("a", "text"), ("b", "text")]}, order={1: 9, 2: 1})
    other = spark.createDataFrame([(7, None, DAY, "x"), (8, "G", DAY, "x")], FILE)
    assert [tuple(r) for r in column_changes(files.unionByName(other), heads).collect()] == [(1, "removed", "b", "")]


def test_no_header_nulls_and_empty(spark):
    files, heads = frames(spark, {1: [("a", None)], 2: [], 3: [("a", None), (None, "text")]})
    assert {tuple(r) for r in column_changes(files, heads).collect()} == {(2, "removed", "a", ""), (3, "added", "", "a")}
    assert column_changes(files.limit(0), heads).count() == 0
    assert column_changes(files, heads.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 5, 50_000])
def test_catalogue_islands_and_casts(spark, block):
    files, heads = frames(spark, HEADS)
    rows = [r for r in column_lifespans(files.unionByName(files), heads, block_files=block).collect()]
    spans = {(r["field"], r["name"], r["type"], r["first_file"]): (r["last_file"], r["n_files"], r["ended_by"], r["cast_to"]) for r in rows}
    assert len(spans) == len(rows)
    # a column that ends and returns has two lifespans
    assert spans["snr", "snr", "integer", 2] == (3, 2, 4, "double")
    assert spans["snr", "snr", "integer", 5] == (5, 1, None, "double")
    assert spans["quantity:pressure", "druck_psi", "number", 2] == (2, 1, 3, "double")
    assert spans["platform", "platform", "text", 1] == (5, 5, None, "string")


def test_one_table(spark):
    _, heads = frames(spark, HEADS)
    lines = [(1, 1, 1, ["P", "10", "3"]), (2, 2, 1, ["Q", "1 psi", "4"]), (3, 9, 1, ["?"]), (1, 1, 1, ["P", "10", "3"]), (4, 3, 1, ["bad", "R", "7", None])]
    lines = spark.createDataFrame(lines, "record_id bigint, file_id bigint, line_no int, cells array<string>")
    whole = one_table(lines, heads)
    assert dict(whole.dtypes)["snr"] == "double" and dict(whole.dtypes)["qc"] == "double" and dict(whole.dtypes)["platform"] == "string"
    rows = whole.collect()
    got = {r.record_id: (r.pressure, r.platform, r.snr, r.others or {}) for r in rows}
    assert len(rows) == 4
    assert got[1] == (10.0, "P", 3.0, {})
    assert got[2] == (pytest.approx(6.894757), "Q", 4.0, {})
    assert got[3] == (None, None, None, {})
    # what can't be cast is kept
    assert got[4][1:] == ("R", None, {"snr": "bad"})
    cells = {(r.record_id, r.field): (r.number, r.text) for r in typed_cells(lines, heads).collect()}
    assert cells == {(1, "platform"): (None, "P"), (1, "snr"): (3.0, None), (2, "platform"): (None, "Q"), (2, "snr"): (4.0, None), (4, "snr"): (None, "bad"), (4, "platform"): (None, "R")}
    assert one_table(lines.limit(0), heads).count() == 0 and one_table(lines, heads.limit(0)).count() == 4


def test_footers_of_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"Platform": ["a"], "snr": [1]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"platform": ["a"], "snr": [1.5], "t": [dt.datetime(2025, 1, 1)]}), tmp_path / "b.parquet")
    (tmp_path / "c.parquet").write_bytes(b"nothing")
    found = {(r.file.rsplit("/", 1)[1], r.ordinal, r.name, r.type) for r in footer_columns(spark, str(tmp_path)).collect()}
    assert found == {("a.parquet", 1, "Platform", "text"), ("a.parquet", 2, "snr", "integer"), ("b.parquet", 1, "platform", "text"), ("b.parquet", 2, "snr", "number"), ("b.parquet", 3, "t", "datetime"), ("c.parquet", None, None, "unreadable")}
