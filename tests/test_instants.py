import datetime as dt

import numpy as np
import pytest

from gaugeflow.operators.instants import NAMES, _valid, fit_mixture, fit_mixtures, to_instants

SCHEMA = "src string, k bigint, t string, tz string, form string"


def utc(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1e6)


CASES = [
    ("2024-03-01T10:00:00Z", None, utc(2024, 3, 1, 10), "canonical"),
    (" 2024-03-01t10:00:00z", None, utc(2024, 3, 1, 10), "converted"),
    ("2024-03-01T10:00:00.1234569+05:30", None, utc(2024, 3, 1, 4, 30, 0, 123456), "converted"),
    ("2024-03-01 10:00:00,5-07", "Europe/Stockholm", utc(2024, 3, 1, 17, 0, 0, 500000), "converted"),
    ("20240301T100000Z", None, utc(2024, 3, 1, 10), "converted"),
    ("2024-061T10:00:00Z", None, utc(2024, 3, 1, 10), "converted"),
    ("2023-366T10:00:00Z", None, None, "none"),
    ("Fri, 01 Mar 2024 10:00:00 +0100", None, utc(2024, 3, 1, 9), "converted"),
    ("01.03.2024 10:00:00.250", "Europe/Stockholm", utc(2024, 3, 1, 9, 0, 0, 250000), "converted"),
    ("01/03/2024 10:00", None, utc(2024, 3, 1, 10), "converted"),
    ("3/1/2024 12:05:00 AM", "America/Denver", utc(2024, 3, 1, 7, 5), "converted"),
    ("3/1/2024 12:05:00 PM", None, utc(2024, 3, 1, 12, 5), "converted"),
    ("2024-10-27 02:30:00", "Europe/Stockholm", utc(2024, 10, 27, 0, 30), "converted"),
    ("2024-07-01 10:00:00 CEST", "America/Denver", utc(2024, 7, 1, 8), "converted"),
    ("1709287200", None, utc(2024, 3, 1, 10), "converted"),
    ("1709287200123", None, utc(2024, 3, 1, 10, 0, 0, 123000), "converted"),
    ("1709287200123456", None, utc(2024, 3, 1, 10, 0, 0, 123456), "converted"),
    ("1709287200123456789", None, utc(2024, 3, 1, 10, 0, 0, 123456), "converted"),
    ("0000-00-00 00:00:00", None, None, "none"),
    ("2024-02-30T00:00:00Z", None, None, "none"),
    ("2024-03-01T24:10:00Z", None, None, "none"),
    ("2024-03-01T10:00", "Mars/Base", None, "zone"),
    ("2024-03-01T10:00Z", "Mars/Base", utc(2024, 3, 1, 10), "converted"),
    ("unknown", None, None, "none"),
    ("", None, None, "none"),
    (None, None, None, "none"),
    ("9" * 10_000, None, None, "none"),
    (" " * 60 + "2024-03-01T10:00:00Z" + " " * 60, None, utc(2024, 3, 1, 10), "converted"),
    ("315532800", None, utc(1980, 1, 1), "converted"),
    ("126230400000", None, utc(1974, 1, 1), "converted"),
    ("86400", None, utc(1970, 1, 2), "converted"),
]


def test_forms_and_zones(spark):
    data = [("S", i, t, z, "clash") for i, (t, z, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(data * 2, SCHEMA)
    found = to_instants(df, source="src", key="k", text="t", zone="tz").collect()
    assert len(found) == len(CASES)
    got = {r.key: (r.utc_us, r.status) for r in found}
    assert got == {i: (u, s) for i, (_, _, u, s) in enumerate(CASES)}


def test_empty_and_null_source(spark):
    df = spark.createDataFrame([(None, 1, "05/06/2024 10:00", None, "")], SCHEMA)
    assert [r.utc_us for r in to_instants(df, source="src", key="k", text="t").collect()] == [utc(2024, 6, 5, 10)]
    assert to_instants(df.limit(0), source="src", key="k", text="t").count() == 0


def test_mixture_prefers_the_forms_of_the_source():
    s, ms = NAMES.index("s"), NAMES.index("ms")
    both = 1 << s | 1 << ms
    form, posterior = fit_mixture([both, 1 << ms], [10, 90])
    assert NAMES[form[0]] == "ms"
    assert posterior[0] > 0.9
    form, posterior = fit_mixture([both], [10])
    assert posterior[0] == pytest.approx(0.5)


def test_a_source_decides_between_day_and_month(spark):
    """Without the rule, texts that fit one order only choose for those that fit both; else these are marked."""
    month = [("A", i, f"{m}/{d}/2024 10:00", None, "") for i, (m, d) in enumerate((m, d) for m in range(1, 13) for d in range(13, 29))]
    both = [(s, 1000 + i, f"0{i}/0{i + 1}/2024 10:00", None, "") for s in "AB" for i in range(1, 6)]
    df = spark.createDataFrame(month + both + [("B", 2000, "2024-01-02T10:00Z", None, "")], SCHEMA)
    ruled = {(r.source, r.key): (r.utc_us, r.status) for r in to_instants(df, source="src", key="k", text="t").collect()}
    free = {(r.source, r.key): (r.utc_us, r.status) for r in to_instants(df, source="src", key="k", text="t", unlikely=0.0).collect()}
    for i in range(1, 6):
        assert ruled["A", 1000 + i] == ruled["B", 1000 + i] == (utc(2024, i + 1, i, 10), "converted")
        assert free["A", 1000 + i] == (utc(2024, i, i + 1, 10), "converted")
        assert free["B", 1000 + i] == (None, "ambiguous")
    assert free["B", 2000] == ruled["B", 2000] == (utc(2024, 1, 2, 10), "converted")
    assert {k: v for k, v in free.items() if k[1] < 1000} == {k: v for k, v in ruled.items() if k[1] < 1000}


def test_many_sources_at_once_are_as_each_alone():
    random = np.random.default_rng(1)
    sets = random.integers(1, 1 << len(NAMES), (20, 5))
    counts = random.integers(1, 100, (20, 5)).astype(float)
    together = fit_mixtures(_valid(sets), counts, -2.0)
    for s, n, p in zip(sets, counts, together, strict=True):
        form, posterior = fit_mixture(s.tolist(), n.tolist(), -2.0)
        assert np.abs(p.max(1) - posterior).max() < 1e-3
