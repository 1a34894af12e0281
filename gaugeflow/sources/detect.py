"""Which parser and sensor type a file belongs to, from its name and header."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of file names and headers by which files are told, each a plain part of the text.
SLOPE_FILES = "slope gnss insar piezo ground_motion egms displacement deformation".split()
SLOPE_HEADERS = (
    "displacement velocity def_x def_y def_z pressure pore_water kpa kilopascal pascal piezo inclinometer "
    "tilt angle depth dataset celsius deformation insar coherence los"
).split()
SLOPE_NOT = "ph conductivity turbidity sulfate".split()
WATER_FILES = "water quality sonde hydro chem lab sample".split()
WATER_HEADERS = "ph conductivity ec turbidity do orp sulfate iron fe tds nitrate mg/l".split()
SENSOR_FILES = {
    "piezometer": "piezo piezometer",
    "inclinometer": "inclin tilt",
    "gnss": "gnss gps",
    "insar": "insar sar egms ground_motion",
    "sonde": "sonde hydro",
    "water_quality": "water quality wq",
}
SENSOR_HEADERS = {
    "piezometer": "pressure kpa pore_water pore dataset kilopascal pascal",
    "inclinometer": "tilt inclin angle deflection",
    "gnss": "displacement velocity def_x def_y def_z",
    "insar": "coherence los deformation",
    "sonde": "ph turbidity conductivity dissolved orp",
    "water_quality": "nitrate sulfate tds mg/l",
}


@dataclass(frozen=True)
class Parser:
    """A parser plugin: a name, and a score from 0 to 1 for (file name, header)."""

    name: str
    detect: Callable[[str, Sequence[str]], float]


def _score(name: str, header: Sequence[str], files: Sequence[str], strong: Sequence[str]) -> tuple[float, list[str]]:
    low = [h.lower().strip() for h in header]
    hits = sum(any(word in h for word in strong) for h in low)
    return 0.2 * any(word in name.lower() for word in files) + (0.4 + 0.15 * hits if hits else 0.0), low


def slope_score(name: str, header: Sequence[str]) -> float:
    score, low = _score(name, header, SLOPE_FILES, SLOPE_HEADERS)
    score += 0.15 * any("(mm)" in h for h in low) - 0.6 * any(word in h for h in low for word in SLOPE_NOT)
    return min(max(score, 0.0), 1.0)


def water_score(name: str, header: Sequence[str]) -> float:
    return min(max(_score(name, header, WATER_FILES, WATER_HEADERS)[0], 0.0), 1.0)


PARSERS = [Parser("slope", slope_score), Parser("water", water_score)]


def route(name: str, header: Sequence[str], parsers: Sequence[Parser] = PARSERS, least: float = 0.6, gap: float = 0.1) -> tuple[str | None, float, str]:
    """(parser, confidence, reason): the best parser, or None with the reason for quarantine."""
    scores = sorted(((p.detect(name, header), -i, p.name) for i, p in enumerate(parsers)), reverse=True)
    scores = [s for s in scores if s[0] > 0]
    if not scores:
        return None, 0.0, "No parser matched"
    if scores[0][0] < least:
        return None, scores[0][0], f"Confidence {scores[0][0]:.2f} is too low"
    if len(scores) > 1 and scores[0][0] - scores[1][0] < gap:
        return None, scores[0][0], f"Ambiguous match between {scores[0][2]} and {scores[1][2]}"
    return scores[0][2], scores[0][0], ""


def sensor_type(file_name: Column, header: Column) -> Column:
    """The first type one of whose words is in the file name, else in the header (array of names), or null."""
    joined = F.lower(F.array_join(header, " "))
    found = F.lit(None).cast("string")
    for text, table in ((joined, SENSOR_HEADERS), (F.lower(file_name), SENSOR_FILES)):
        for kind, words in reversed(table.items()):
            test = F.lit(False)
            for word in words.split():
                test = test | F.coalesce(F.contains(text, F.lit(word)), F.lit(False))
            found = F.when(test, kind).otherwise(found)
    return found
