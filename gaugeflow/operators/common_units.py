"""Values recorded in different units, converted to the common unit of their quantity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.columns import normal_name, quantity_of, unit_text_of
from gaugeflow.functions.units import read_unit

#: A number at the start of a cell: digits, perhaps grouped by blanks, a decimal point or comma, an exponent.
#: What follows must not go on as a word of the number; it is the unit's text.
_CELL = r"^([+-]?)((?:\d{1,3}(?:[   ]\d{3})+|\d+)?(?:[.,]\d+)*)((?:[eE][+-]?\d+)?)[  ]*((?![\d.,]).*)$"
#: Fixed value: the mark of a missing reading.
MISSING = -9999.0


def _number(sign: Column, digits: Column, exponent: Column) -> Column:
    plain = F.regexp_replace(digits, r"[   ]", "")
    # of several marks the last is the decimal one
    plain = F.regexp_replace(plain, r"[.,](?=.*[.,])", "")
    return F.concat(sign, F.translate(plain, ",", "."), exponent).try_cast("double")


_UNIT = "struct<factor:double,offset:double,common:boolean>"


def _unit(quantity: Column, text: Column) -> Column:
    """What a unit text stands for in a field, or null. Each worker reads a text once: data have few."""

    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for quantities, texts in parts:
            units = [read_unit(t, q) if t and q else None for q, t in zip(quantities, texts, strict=True)]
            yield pd.DataFrame([u or (None, None, None) for u in units], columns=["factor", "offset", "common"]).astype({"factor": "float64", "offset": "float64", "common": "boolean"})

    # declared nondeterministic, so that filters on the result aren't pushed down as a second call
    return F.pandas_udf(read, _UNIT).asNondeterministic()(quantity, text)


def quantity_columns(headers: DataFrame) -> DataFrame:
    """(file_id, ordinal, normal, quantity, unit_text) of each column that holds one of the five quantities.

    A column holds a quantity if its normal name is one of the quantity's names, alone or followed by a
    unit of the quantity. Null names and repeated rows fall away.
    """
    named = headers.select("file_id", "ordinal", normal_name(F.col("name")).alias("normal")).distinct()
    named = named.withColumns({"quantity": quantity_of(F.col("normal")), "unit_text": unit_text_of(F.col("normal"))}).filter("quantity is not null")
    named = named.withColumn("_unit", _unit(F.col("quantity"), F.col("unit_text")))
    return named.filter("unit_text = '' or _unit.factor is not null").select("file_id", "ordinal", "normal", "quantity", "unit_text")


def to_common_units(records: DataFrame, headers: DataFrame, converted_only: bool = False) -> DataFrame:
    """Each value of a quantity in its common unit: (record_id, file_id, ordinal, quantity, raw, unit_text,
    reading, value, converted), each once.

    records: record_id, file_id, cells (array of text, by ordinal from 1); headers: file_id, ordinal, name.
    The unit in the cell beats that in the column's name; without either the value is in the common unit.
    converted: its unit isn't the common one; converted_only leaves out the others. Cells that are null, no
    number, or -9999 hold no value; so does a number followed by something that is no unit of the quantity,
    or an ambiguous one. Short lines lack their last cells. Repeated rows give one result; other columns are
    ignored; empty tables give an empty result.

    One pass over the lines: numbers are parsed in Spark's expressions, unit texts in batches in Python. A
    file's header goes to its lines by a join on file_id, of which the adaptive planner splits files that
    hold much of the data.
    """
    fields = quantity_columns(headers)
    fields = fields.groupBy("file_id").agg(F.collect_set(F.struct("ordinal", "quantity", "unit_text")).alias("_fields"))
    cells = records.select("record_id", "file_id", "cells").join(fields, "file_id").select("record_id", "file_id", "cells", F.explode("_fields").alias("_f"))
    cells = cells.select("record_id", "file_id", "_f.ordinal", "_f.quantity", F.col("_f.unit_text").alias("_named"), F.get("cells", F.col("_f.ordinal") - 1).alias("raw"))
    text = F.regexp_replace("raw", r"^[\s ]+|[\s ]+$", "")
    parts = F.split(F.regexp_replace(text, _CELL, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    # exploding a single struct keeps the filters below from being pushed down as copies of the parsing
    cells = cells.select("*", F.explode(F.array(F.struct(parts.alias("_p")))).alias("_x")).select("*", "_x._p").drop("_x").filter(F.size("_p") == 4)
    reading = _number(F.col("_p")[0], F.col("_p")[1], F.col("_p")[2])
    unit_text = F.when(F.col("_p")[3] != "", F.col("_p")[3]).otherwise(F.col("_named"))
    cells = cells.select("*", F.explode(F.array(F.struct(reading.alias("reading"), unit_text.alias("unit_text")))).alias("_x")).select("*", "_x.*").drop("_x", "_p", "_named")
    cells = cells.filter(F.col("reading").isNotNull() & (F.col("reading") != MISSING))
    if converted_only:
        cells = cells.filter("unit_text != ''")
    plain = F.col("unit_text") == ""
    cells = cells.withColumn("_u", _unit(F.col("quantity"), F.col("unit_text"))).filter(plain | F.col("_u.factor").isNotNull())
    value = F.when(plain, F.col("reading")).otherwise(F.col("reading") * F.col("_u.factor") + F.col("_u.offset"))
    cells = cells.withColumns({"value": value, "converted": F.when(plain, F.lit(False)).otherwise(~F.col("_u.common"))})
    if converted_only:
        cells = cells.filter("converted")
    return cells.select("record_id", "file_id", "ordinal", "quantity", "raw", "unit_text", "reading", "value", "converted").distinct()
