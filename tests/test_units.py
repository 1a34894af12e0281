import pytest
from hypothesis import given
from hypothesis import strategies as st

from gaugeflow.functions.units import QUANTITIES, read_unit
from gaugeflow.operators.common_units import quantity_columns, to_common_units

CASES = [
    ("kPa", "pressure", 1, 0), ("hPa", "pressure", 0.1, 0), ("mbar", "pressure", 0.1, 0), ("Bar", "pressure", 100, 0), ("PSI", "pressure", 6.894757, 0),
    ("lbf/in2", "pressure", 6.894757, 0), ("m H2O", "pressure", 9.80665, 0), ("mh2o", "pressure", 9.80665, 0), ("MPa", "pressure", 1000, 0),
    ("K", "temperature", 1, -273.15), ("°F", "temperature", 5 / 9, -160 / 9), ("degc", "temperature", 1, 0),
    ("MM", "deformation", 1, 0), ("µm", "deformation", 0.001, 0), ('"', "deformation", 25.4, 0), ("in", "deformation", 25.4, 0), ("M", "deformation", 1000, 0),
    ("'", "level", 0.3048, 0), ("feet", "level", 0.3048, 0), ("cm", "level", 0.01, 0),
    ("l_min", "flow", 1 / 60, 0), ("m3_h", "flow", 1 / 3.6, 0), ("m³/h", "flow", 1 / 3.6, 0), ("GPM", "flow", 3.785411784 / 60, 0), ("cmh", "flow", 1 / 3.6, 0), ("L/s", "flow", 1, 0),
]


@pytest.mark.parametrize(("text", "quantity", "factor", "offset"), CASES)
def test_units(text, quantity, factor, offset):
    unit = read_unit(text, quantity)
    assert unit.factor == pytest.approx(factor, rel=1e-9)
    assert unit.offset == pytest.approx(offset, abs=1e-9)
    assert unit.common == (abs(factor - 1) < 1e-9 and offset == 0)


@pytest.mark.parametrize(("text", "quantity"), [("V", "pressure"), ("s", "flow"), ("", "level"), ("m" * 100, "level"), ("kPa", "level"), ("off, redone", "level")])
def test_no_unit(text, quantity):
    assert read_unit(text, quantity) is None


@given(st.text(max_size=40), st.sampled_from(sorted(QUANTITIES)))
def test_any_text_is_a_unit_or_none(text, quantity):
    unit = read_unit(text, quantity)
    assert unit is None or unit.factor > 0


def test_cells(spark):
    headers = spark.createDataFrame(
        [(1, 1, "Druck [psi]", "number", 0), (1, 2, "water temp", "number", 0), (1, 3, "depth_sensor", "number", 0), (1, 4, "flow/l_min", "NUMBER", 0), (1, 4, "flow/l_min", "NUMBER", 0), (None, 1, None, None, 0), (2, 1, "nivel", "number", 0)],
        "file_id bigint, ordinal int, name string, type string, quantity int",
    )
    assert {(r.file_id, r.ordinal, r.quantity) for r in quantity_columns(headers).collect()} == {(1, 1, "pressure"), (1, 2, "temperature"), (1, 4, "flow"), (2, 1, "level")}
    lines = [
        (1, 1, ["10", "50,0 °F", "7", "1 200"]), (2, 1, ["2 bar", "-9999", "7", "60 l/min"]), (3, 1, [None, "", "x", "ok"]), (4, 1, ["1.5e+01 KPa", "21,5", "7", "3 ft off, redone"]),
        (2, 1, ["2 bar", "-9999", "7", "60 l/min"]), (5, 2, []), (6, None, ["1"]), (7, 2, None), (8, 2, ["9" * 5000]), (9, 2, ["1.234,5 cm"]),
    ]
    records = spark.createDataFrame(lines, "record_id bigint, file_id bigint, cells array<string>")
    got = sorted((r.record_id, r.ordinal, round(r.value, 4), r.converted) for r in to_common_units(records, headers).collect() if r.record_id != 8)
    assert got == [(1, 1, 68.9476, True), (1, 2, 10.0, True), (1, 4, 20.0, True), (2, 1, 200.0, True), (2, 4, 1.0, True), (4, 1, 15.0, False), (4, 2, 21.5, False), (9, 1, 12.345, True)]
    only = to_common_units(records, headers, converted_only=True).collect()
    assert {r.record_id for r in only} == {1, 2, 9}
    assert to_common_units(records.limit(0), headers).count() == 0
    assert to_common_units(records, headers.limit(0)).count() == 0
