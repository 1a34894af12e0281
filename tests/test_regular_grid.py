import pytest

from gaugeflow.operators.regular_grid import missing_slots, regular_series

MESSAGE = "message_id bigint, platform string, sensor_type string, timestamp string, pressure_kpa double, temperature_c double, slot string"
KINDS = [("piezometer", 900), ("geophone", 10)]


def message(i, platform, kind, when, pressure=1.0, temperature=None):
    return (i, platform, kind, when, pressure, temperature, "clash")


def found(spark, data, **more):
    df = spark.createDataFrame(data, MESSAGE)
    kinds = spark.createDataFrame(KINDS, "sensor_type string, period_s int")
    return sorted((r.source, r.slot * r.period) for r in missing_slots(df, kinds, **more).collect())


def base(n):
    from datetime import datetime, timezone

    return int(datetime(2025, 1, 1, tzinfo=timezone.utc).timestamp()) + n


@pytest.mark.parametrize("shard", [2, 3, 4096])
def test_gaps_inside_and_across_shards(spark, shard):
    data = [
        message(1, "P", " Piezometer ", "2025-01-01T00:01:00Z"),
        message(2, "P", None, "2025-01-01T00:46:00.500Z"),
        message(3, "P", "PIEZOMETER", "2025-01-01T00:47:00"),
        message(4, "P", "piezometer", "2025-01-01T02:00:00Z", None, 3.0),
        message(5, "P", "piezometer", "2025-01-01T01:00:00Z", None, float("nan")),
        message(6, "P", "piezometer", "1970-01-02T00:00:00Z"),
        message(7, "Q", None, "2025-01-01T00:00:00Z"),
        message(8, "Q", None, "2025-01-01T09:00:00Z"),
        message(9, None, "geophone", "2025-01-01T09:00:00Z"),
        message(10, "P", "piezometer", "soon"),
        message(10, "P", "piezometer", "soon"),
    ]
    expected = [("P", base(900 * i)) for i in (1, 2, 4, 5, 6, 7)]
    assert found(spark, data, shard_slots=shard) == expected


def test_empty(spark):
    assert found(spark, []) == []


def test_series_marks_missing(spark):
    data = [message(1, "G", "geophone", "2025-01-01T00:00:01Z", 2.0), message(2, "G", "geophone", "2025-01-01T00:00:05Z", 4.0), message(2, "G", "geophone", "2025-01-01T00:00:05Z", 4.0), message(3, "G", None, "2025-01-01T00:00:20Z", None, 5.0)]
    df = spark.createDataFrame(data, MESSAGE)
    kinds = spark.createDataFrame(KINDS, "sensor_type string, period_s int")
    rows = sorted((r.slot_start_us // 10**6 - base(0), r.n_messages, r.pressure_kpa, r.missing) for r in regular_series(df, kinds).collect())
    assert rows == [(0, 2, 3.0, False), (10, 0, None, True), (20, 1, None, False)]
