"""Column names: normal form, and the quantity and unit text that they hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow.functions.units import ALIASES

_QUANTITY = {alias: quantity for quantity, names in ALIASES.items() for alias in names.split()}
#: Longest alias first, each up to the end of the name or an underscore.
_NAME = "^(" + "|".join(sorted(_QUANTITY, key=lambda a: (-len(a), a))) + ")(?:_(.+))?$"


def normal_name(name: Column) -> Column:
    """Lower case; runs of characters other than letters and digits made one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


def quantity_of(name: Column) -> Column:
    """The quantity that a normal name begins with, or null; unit_text_of() must be empty or a unit of it."""
    alias = F.regexp_extract(name, _NAME, 1)
    table = F.create_map(*[F.lit(x) for pair in sorted(_QUANTITY.items()) for x in pair])
    return F.when(alias != "", F.try_element_at(table, alias))


def unit_text_of(name: Column) -> Column:
    """What follows the quantity in a normal name, or an empty text."""
    return F.regexp_extract(name, _NAME, 2)
