import datetime as dt

import numpy as np
import pytest

from gaugeflow.operators.spikes import flag_spikes

SCHEMA = "platform string, measurement_date date, id bigint, ph double, source string"
DAY = dt.date(2025, 1, 1)


def series(values, platform="A", first=0):
    return [(platform, DAY + dt.timedelta(days=i), first + i, v, "other") for i, v in enumerate(values)]


def flags(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA)
    found = flag_spikes(df, source="platform", when="measurement_date", key="id", value="ph", low=0, high=14, **more)
    return {(r.key, r.reason) for r in found.collect()}


def calm(n, seed=0):
    return np.round(7 + np.random.default_rng(seed).normal(0, 0.05, n), 2).tolist()


def test_spikes_runs_and_ranges(spark):
    v = calm(80)
    v[20] = 9.5
    v[30:33] = [4.0, 4.1, 4.05]
    v[50] = 17.0
    v[60:68] = [7.11] * 8
    expected = {(20, "spike"), (30, "spike"), (31, "spike"), (32, "spike"), (50, "range")} | {(i, "frozen") for i in range(60, 68)}
    assert flags(spark, series(v)) == expected
    # blocks far smaller than the series give the same
    assert flags(spark, series(v), block_rows=24) == expected


def test_lasting_change_longer_excursion_and_short_run_are_no_cases(spark):
    v = calm(80, 1)
    v[40:] = [x + 3 for x in v[40:]]
    assert flags(spark, series(v)) == set()
    w = calm(80, 2)
    w[30:35] = [x + 3 for x in w[30:35]]
    w[60:67] = [7.13] * 7
    assert flags(spark, series(w)) == set()


def test_frozen_run_longer_than_a_block_between_levels(spark):
    v = calm(120, 3)
    v[40:75] = [7.05] * 35
    v[39] = 9.0
    found = flags(spark, series(v), block_rows=24)
    assert found == {(i, "frozen") for i in range(40, 75)} | {(39, "spike")}


@pytest.mark.parametrize("data", [[], series([None, float("nan"), 7.0])])
def test_empty_and_missing(spark, data):
    assert flags(spark, data) == set()


def test_repeats_nulls_and_sources(spark):
    v = calm(40, 4)
    v[10] = 12.0
    data = series(v) * 2 + series(v, None, 1000)
    assert flags(spark, data) == {(10, "spike"), (1010, "spike")}


def test_fences_and_rates(spark):
    v = calm(120, 5)
    v[100:104] = [x + 0.6 for x in v[100:104]]  # four in a row are no spike, but outside the fences
    data = series(v)
    # a slow climb that is quick at one place: ten readings a day there
    climb = [float(round(7 + 0.004 * i + e, 3)) for i, e in enumerate(np.random.default_rng(6).normal(0, 0.02, 80))]
    data += [("B", (DAY + dt.timedelta(days=i * 10)), 1000 + i, x, "o") for i, x in enumerate(climb)]
    quick = (DAY + dt.timedelta(days=401), 1080, round(climb[40] + 0.15, 3))
    data.append(("B", quick[0], quick[1], quick[2], "o"))
    plain, more = flags(spark, data), flags(spark, data, fence=6.0)
    assert {k for k, r in more if r == "fence"} >= {100, 101, 102, 103} - {k for k, _ in plain}
    assert (1080, "rate") in more
    assert {(k, r) for k, r in more if r in ("range", "frozen", "spike")} == plain
    assert len(more - plain) < 20
