"""Unit texts read by dynamic programming over tries of prefixes, roots and exponents.

A text such as 'mbar', 'l/min' or 'm3_h' is cut into factors [prefix] root [exponent], joined by nothing, a
blank, a dot, an underscore or a division mark. Every cut has a cost; a cut whose dimension is that of the
field's quantity is preferred by the field's prior. The cheapest cut wins; if two cuts of the same cost
disagree about the value, the text is ambiguous and no unit.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

#: Dimensions as exponents of (length, mass, time, temperature).
LENGTH, TIME, TEMPERATURE = (1, 0, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1)
VOLUME, FORCE, PRESSURE, FLOW = (3, 0, 0, 0), (1, 1, -2, 0), (-1, 1, -2, 0), (3, 0, -1, 0)
WATER_COLUMN = (-2, 1, -2, 0)

#: Quantity -> dimension, common unit, its size in SI units, its zero in SI units.
QUANTITIES = {
    "pressure": (PRESSURE, "kPa", 1000.0, 0.0),
    "temperature": (TEMPERATURE, "degC", 1.0, 273.15),
    "deformation": (LENGTH, "mm", 0.001, 0.0),
    "level": (LENGTH, "m", 1.0, 0.0),
    "flow": (FLOW, "l/s", 0.001, 0.0),
}

#: Column names of each quantity, in English, German and Spanish, in normal form.
ALIASES = {
    "pressure": "pressure pore_pressure porewater_pressure water_pressure druck wasserdruck porenwasserdruck porendruck presion presion_de_poros presion_del_agua",
    "temperature": "temperature temp t_water water_temp water_temperature temperatur wassertemperatur temperatura temperatura_del_agua",
    "deformation": "deformation los_deformation def_x displacement settlement verschiebung verformung setzung desplazamiento deformacion asentamiento",
    "level": "level water_level head depth wasserstand pegel tiefe nivel nivel_del_agua profundidad",
    "flow": "flow flow_rate discharge seepage durchfluss abfluss sickerwasser caudal filtracion",
}

#: Metric prefixes.
PREFIXES = {"k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "M": 1e6, "G": 1e9}

_PSI, _GALLON, _WATER = 6894.757, 3.785411784e-3, 9806.65
#: Root -> (dimension, size in SI units, zero in SI units, takes metric prefixes).
ROOTS = {
    "Pa": (PRESSURE, 1.0, 0.0, True),
    "bar": (PRESSURE, 1e5, 0.0, True),
    "psi": (PRESSURE, _PSI, 0.0, False),
    "lbf": (FORCE, _PSI * 0.0254**2, 0.0, False),
    "H2O": (WATER_COLUMN, _WATER, 0.0, False),
    "m": (LENGTH, 1.0, 0.0, True),
    "metre": (LENGTH, 1.0, 0.0, False),
    "meter": (LENGTH, 1.0, 0.0, False),
    "in": (LENGTH, 0.0254, 0.0, False),
    "inch": (LENGTH, 0.0254, 0.0, False),
    '"': (LENGTH, 0.0254, 0.0, False),
    "ft": (LENGTH, 0.3048, 0.0, False),
    "feet": (LENGTH, 0.3048, 0.0, False),
    "foot": (LENGTH, 0.3048, 0.0, False),
    "'": (LENGTH, 0.3048, 0.0, False),
    "l": (VOLUME, 1e-3, 0.0, True),
    "gal": (VOLUME, _GALLON, 0.0, False),
    "s": (TIME, 1.0, 0.0, False),
    "sec": (TIME, 1.0, 0.0, False),
    "min": (TIME, 60.0, 0.0, False),
    "h": (TIME, 3600.0, 0.0, False),
    "d": (TIME, 86400.0, 0.0, False),
    "gpm": (FLOW, _GALLON / 60, 0.0, False),
    "lpm": (FLOW, 1e-3 / 60, 0.0, False),
    "lps": (FLOW, 1e-3, 0.0, False),
    "cmh": (FLOW, 1 / 3600, 0.0, False),
    "cms": (FLOW, 1.0, 0.0, False),
    "K": (TEMPERATURE, 1.0, 0.0, False),
    "kelvin": (TEMPERATURE, 1.0, 0.0, False),
    "C": (TEMPERATURE, 1.0, 273.15, False),
    "°C": (TEMPERATURE, 1.0, 273.15, False),
    "degC": (TEMPERATURE, 1.0, 273.15, False),
    "celsius": (TEMPERATURE, 1.0, 273.15, False),
    "F": (TEMPERATURE, 5 / 9, 459.67 * 5 / 9, False),
    "°F": (TEMPERATURE, 5 / 9, 459.67 * 5 / 9, False),
    "degF": (TEMPERATURE, 5 / 9, 459.67 * 5 / 9, False),
    "fahrenheit": (TEMPERATURE, 5 / 9, 459.67 * 5 / 9, False),
}
EXPONENTS = {"2": 2, "3": 3, "^2": 2, "^3": 3}

#: The prefixed units that instruments of a quantity commonly use, its field prior.
USUAL = {"pressure": "kPa hPa MPa mbar", "temperature": "", "deformation": "mm cm um µm", "level": "cm mm", "flow": "ml"}

#: Costs in halves of nats: a part more, a prefix, another case, a mark that may divide, a prefix that is
#: unusual for the field, the wrong dimension.
_PART, _PREFIX, _CASE, _GUESS, _UNUSUAL, _WRONG = 2, 1, 1, 1, 3, 40
#: No unit costs more, which bounds the search in texts of any length.
_MOST = 40
#: Characters of texts whose readings are kept.
_KEPT = 64


class Unit(NamedTuple):
    """value in common units = reading * factor + offset."""

    factor: float
    offset: float
    common: bool


def _trie(words) -> dict:
    root: dict = {}
    for word in words:
        node = root
        for letter in word.lower():
            node = node.setdefault(letter, {})
        node.setdefault("", []).append(word)
    return root


_PREFIX_TRIE, _ROOT_TRIE, _EXPONENT_TRIE = _trie(PREFIXES), _trie(ROOTS), _trie(EXPONENTS)


def _walk(trie: dict, text: str, at: int):
    """(end, word) of every word of the trie that begins at this place, case apart."""
    node, end = trie, at
    while True:
        for word in node.get("", ()):
            yield end, word
        if end == len(text) or text[end].lower() not in node:
            return
        node, end = node[text[end].lower()], end + 1


def _case(word: str, text: str, at: int, end: int) -> int:
    return _CASE * (word != text[at:end])


def _factors(text: str, at: int, quantity: str):
    """(end, dimension, size, zero, cost) of every [prefix] root [exponent] that begins here."""
    starts = [(at, 1.0, 0, "")]
    starts += [(end, PREFIXES[p], _PREFIX + _case(p, text, at, end), p) for end, p in _walk(_PREFIX_TRIE, text, at)]
    for begin, scale, cost, prefix in starts:
        for end, root in _walk(_ROOT_TRIE, text, begin):
            dimension, size, zero, takes = ROOTS[root]
            if prefix and not takes:
                continue
            unusual = bool(prefix) and prefix + root not in USUAL[quantity].split()
            spent = cost + _PART + _case(root, text, begin, end) + _UNUSUAL * unusual
            yield end, dimension, scale * size, zero, spent
            for stop, power in _walk(_EXPONENT_TRIE, text, end):
                n = EXPONENTS[power]
                yield stop, tuple(n * x for x in dimension), (scale * size) ** n, 0.0, spent


#: Joints between factors: mark -> possible signs of what follows, and their costs.
_JOINTS = {"": ((1, 1),), " ": ((1, 0), (-1, _GUESS)), "_": ((1, _GUESS), (-1, _GUESS)), "*": ((1, 0),), "·": ((1, 0),), "/": ((-1, 0),), " per ": ((-1, 0),)}


def _clean(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).replace("μ", "µ").replace("º", "°").replace("° ", "°")
    return re.sub(r"\s+", " ", folded).strip(" .()[]")


def read_unit(text: str, quantity: str) -> Unit | None:
    """The unit that text denotes for a quantity; None if it is no unit of it, or an ambiguous one."""
    return (_read_unit if len(text) <= _KEPT else _read_unit.__wrapped__)(text, quantity)


@lru_cache(maxsize=65536)
def _read_unit(text: str, quantity: str) -> Unit | None:
    wanted, _, common_size, common_zero = QUANTITIES[quantity]
    text = _clean(text)
    if not text:
        return None
    # at each place: (dimension, size, zero, sign of the next factor) -> least cost
    best: list[dict] = [{} for _ in range(len(text) + 1)]
    best[0][((0, 0, 0, 0), 1.0, 0.0, 1, True)] = 0
    for at in range(len(text)):
        for (dimension, size, zero, sign, first), cost in list(best[at].items()):
            for end, more, scale, start, spent in _factors(text, at, quantity):
                if cost + spent > _MOST:
                    continue
                whole = tuple(a + sign * b for a, b in zip(dimension, more, strict=True))
                total, origin = size * scale**sign, start if first else 0.0
                if end == len(text):
                    key = (whole, float(f"{total:.12g}"), origin, 0, False)
                    best[end][key] = min(best[end].get(key, 10**6), cost + spent)
                    continue
                for mark, signs in _JOINTS.items():
                    if text.startswith(mark, end):
                        for turn, price in signs:
                            key = (whole, total, origin, turn, False)
                            stop = end + len(mark)
                            if stop < len(text):
                                best[stop][key] = min(best[stop].get(key, 10**6), cost + spent + price)
    ends = sorted((cost + _WRONG * (key[0] != wanted), key[0] == wanted, key[1], key[2]) for key, cost in best[len(text)].items() if key[3] == 0)
    if not ends or not ends[0][1]:
        return None
    least = {(size, zero) for cost, _, size, zero in ends if cost == ends[0][0]}
    if len(least) > 1:
        return None
    _, _, size, zero = ends[0]
    factor, offset = size / common_size, (zero - common_zero) / common_size
    return Unit(factor, offset, abs(factor - 1) < 1e-9 and abs(offset) < 1e-6)
