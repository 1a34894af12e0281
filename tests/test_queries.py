"""Every query with SQL against DuckDB on the smallest tables, and the entry points."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gaugeflow.plans import monitoring, problems

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = {**problems.ORACLE, **monitoring.ORACLE}
QUERIES = {**problems.QUERIES, **monitoring.QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, list):
        return str([value(x) for x in v])
    if isinstance(v, float):
        return f"{v:.5g}" if v else "0"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    found = tables.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns
    df.collect()


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["platform", "slot_start_us"]
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.queries().keys()
