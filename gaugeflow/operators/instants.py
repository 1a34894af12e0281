"""Time texts of mixed form, precision and zone, made one unambiguous instant each.

Every text is matched with every form; a form that fits gives a reading. Where several fit, a mixture of
forms is fitted for each source by expectation-maximisation over counts of form sets: a text adds to the
likelihood of each reading that is valid for it, the posterior chooses, and what stays undecided is marked.
Texts of forms that never compete with another don't bear on the choice, so only the others are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import cut

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_ZONE = r" ?(z|[+-]\d{2}(?::?\d{2})?|(?![ap]m$)[a-z]{2,5})?"
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

#: Zone abbreviations and their offsets from UTC in minutes.
ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "BRT": -180, "IST": 330,
    "JST": 540, "AWST": 480, "ACST": 570, "AEST": 600, "AEDT": 660,
}

#: Shapes, of which a text has at most one: name -> (pattern over the lower-case text, its groups laid out as
#: year|month|day|hour|minute|second|fraction|half|zone). The month is a number, a name, or j for a day of the year.
SHAPES = {
    "iso": (r"(\d{4})-(\d{2})-(\d{2})[t ]" + _CLOCK + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8"),
    "basic": (r"(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE, "$1|$2|$3|$4|$5|$6|$7||$8"),
    "ordinal": (r"(\d{4})-(\d{3})[t ]" + _CLOCK + _ZONE, "$1|j|$2|$3|$4|$5|$6||$7"),
    "mail": (r"(?:[a-z]{3}, )?(\d{1,2}) (" + "|".join(_MONTHS) + r") (\d{4}) " + _CLOCK + _ZONE, "$3|$2|$1|$4|$5|$6|$7||$8"),
    "day_first": (r"(\d{1,2})[./](\d{1,2})[./](\d{4}) " + _CLOCK + _ZONE, "$3|$2|$1|$4|$5|$6|$7||$8"),
    "month_first_12h": (r"(\d{1,2})[./](\d{1,2})[./](\d{4}) " + _CLOCK + " ?([ap])m" + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
}
#: With dots and slashes the day comes first, but the month with a twelve-hour clock. The other order is a
#: reading too, with a prior that lets it win only where the usual order is no date.
SWAPPED = {"day_first": "month_first", "month_first_12h": "day_first_12h"}
UNLIKELY = -30.0
#: Bare digits since 1970: name -> how many make a second.
EPOCHS = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}
#: Bare digits are read as each unit that puts them between these years; if none does, as their number of digits tells.
YEARS = (1985, 2100)
#: Numbers below these are seconds, milli- and microseconds; the larger ones are nanoseconds.
MAGNITUDES = (10**11, 10**14, 10**17)
NAMES = [*SHAPES, *SWAPPED.values(), *EPOCHS]
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: Texts that may have several readings: dates with dots or slashes, and bare digits.
_SEVERAL = r"^[\s ]*(\d{1,2}[./]\d|\d{1,20}[\s ]*$)"
_SALTS = 16


def _wall(year: Column, month: Column, day: Column, parts: Column) -> Column:
    """Microseconds of the wall clock; null if there is no such date or time."""
    date = F.try_make_timestamp_ntz(year, month, day, *[F.lit(0)] * 3).cast("date")
    first = F.try_make_timestamp_ntz(year, *[F.lit(1)] * 2, *[F.lit(0)] * 3).cast("date")
    nth = F.date_add(first, day - 1)
    date = F.when(parts[1] == "j", F.when((day >= 1) & (F.year(nth) == year), nth)).otherwise(date)
    hour, minute, second = (parts[i].try_cast("int") for i in (3, 4, 5))
    second = F.coalesce(second, F.lit(0))
    half = F.when(parts[7] == "p", 12).when(parts[7] == "a", 0)
    hours = F.when(half.isNull(), hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + half)
    micros = F.coalesce(F.rpad(F.substring(parts[6], 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    seconds = F.unix_date(date).cast("bigint") * 86400 + hours * 3600 + minute * 60 + second
    return F.when((hours < 24) & (minute < 60) & (second < 60), seconds * 1_000_000 + micros)


def _utc(wall: Column, zone: Column, place: Column) -> Column:
    """The instant of a wall clock; a zone in the text beats the place. An hour that occurs twice is the first."""
    table = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    digits = F.regexp_replace(zone, r"[^\d]", "")
    minutes = F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    offset = F.when(zone.rlike(r"^[+-]"), F.when(zone.startswith("-"), -minutes).otherwise(minutes)).otherwise(F.try_element_at(table, F.upper(zone)))
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(wall), place))
    return F.when(zone.isNotNull(), wall - offset.cast("bigint") * 60_000_000).otherwise(local)


def _with_readings(rows: DataFrame, text: Column) -> DataFrame:
    """rows with _shape, _zone and _r: the instants in usual and in swapped order and of each epoch, or nulls."""
    rows = rows.withColumn("_low", F.lower(F.regexp_replace(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""), r"[\s ]+", " ")))
    laid = F.lit(None).cast("string")
    for i, (pattern, layout) in reversed(list(enumerate(SHAPES.values()))):
        laid = F.when(F.col("_low").rlike(f"^{pattern}$"), F.concat(F.regexp_replace("_low", f"^{pattern}$", layout), F.lit(f"|{i}"))).otherwise(laid)
    rows = rows.withColumn("_p", F.split(laid, r"\|"))
    parts = F.col("_p")
    names = F.create_map(*[F.lit(x) for i, m in enumerate(_MONTHS) for x in (m, i + 1)])
    month = F.coalesce(parts[1].try_cast("int"), F.try_element_at(names, parts[1]))
    rows = rows.withColumns({"_shape": parts[9].cast("int"), "_zone": F.nullif(parts[8], F.lit("")), "_y": parts[0].try_cast("int"), "_mo": month, "_d": parts[2].try_cast("int")})
    swaps = F.col("_shape").isin([i for i, n in enumerate(SHAPES) if n in SWAPPED])
    usual = _wall(F.col("_y"), F.col("_mo"), F.col("_d"), parts)
    other = F.when(swaps, _wall(F.col("_y"), F.col("_d"), F.col("_mo"), parts))
    rows = rows.withColumns({"_usual": usual, "_other": other})
    bare = F.when(F.col("_low").rlike(r"^\d{1,20}$"), F.col("_low").try_cast("decimal(20,0)"))
    years = [int(pd.Timestamp(year=y, month=1, day=1).value // 1000) for y in YEARS]
    units = [(bare * (10**6 // n) if n <= 10**6 else F.floor(bare / (n // 10**6))).try_cast("bigint") for n in EPOCHS.values()]
    usual_years = units[0].between(*years)
    for micros in units[1:]:
        usual_years = usual_years | F.coalesce(micros.between(*years), F.lit(False))
    usual_years = F.coalesce(usual_years, F.lit(False))
    sizes = [0, *MAGNITUDES]
    of_size = [sum(((bare >= n).cast("int") for n in sizes), F.lit(0)) == i + 1 for i in range(len(sizes))]
    epochs = [F.when(F.when(usual_years, micros.between(*years)).otherwise(fits), micros) for micros, fits in zip(units, of_size, strict=True)]
    clocks = [_utc(F.col(c), F.col("_zone"), F.col("_place")) for c in ("_usual", "_other")]
    return rows.withColumn("_r", F.array(*clocks, *epochs)).drop("_low", "_p", "_y", "_mo", "_d", "_usual", "_other")


def _with_forms(rows: DataFrame) -> DataFrame:
    """rows with _f: the readings that are instants, as (form, utc), and _set: the bit mask of their forms."""
    rows = _with_readings(rows, F.col("text"))
    # the form of each place in _r; places 0 and 1 depend on the shape
    swapped = F.create_map(*[F.lit(NAMES.index(n)) for pair in SWAPPED.items() for n in pair])
    forms = F.array(F.col("_shape"), F.try_element_at(swapped, F.col("_shape")), *[F.lit(NAMES.index(e)) for e in EPOCHS])
    rows = rows.withColumn("_f", F.filter(F.arrays_zip(forms.alias("form"), F.col("_r").alias("utc")), lambda x: x.utc.isNotNull()))
    bits = F.aggregate("_f", F.lit(0), lambda sum, x: sum + F.pow(F.lit(2), x.form).cast("int"))
    # exploding a single struct keeps later filters from being pushed down as copies of all this parsing
    rows = rows.select("source", "key", "text", "_shape", "_zone", "_known", F.explode(F.array(F.struct("_f", bits.alias("_set")))).alias("_x"))
    return rows.select("source", "key", "text", "_shape", "_zone", "_known", "_x.*")


def fit_mixtures(valid: np.ndarray, counts: np.ndarray, unlikely: float = UNLIKELY, rounds: int = 200) -> np.ndarray:
    """EM for many sources at once: the posteriors (source, set, form) of counts (source, set) texts whose valid
    forms are valid (source, set, form). Weights start equal; the forms' priors stay part of the likelihood."""
    prior = np.exp([unlikely if n in SWAPPED.values() else 0.0 for n in NAMES])
    weights = np.full((len(valid), len(NAMES)), 1 / len(NAMES))
    for _ in range(rounds):
        likelihood = valid * (weights * prior)[:, None, :]
        posterior = likelihood / np.maximum(likelihood.sum(2, keepdims=True), 1e-300)
        new = (counts[:, :, None] * posterior).sum(1) + 1e-6
        new /= new.sum(1, keepdims=True)
        if np.abs(new - weights).max() < 1e-9:
            break
        weights = new
    return posterior


def fit_mixture(sets: list[int], counts: list[int], unlikely: float = UNLIKELY) -> tuple[np.ndarray, np.ndarray]:
    """One source: sets are bit masks of the forms valid for counts texts; gives each set's chosen form and its posterior."""
    posterior = fit_mixtures(_valid(np.array([sets])), np.array([counts], float), unlikely)[0]
    return posterior.argmax(1), posterior.max(1)


def _valid(sets: np.ndarray) -> np.ndarray:
    """(..., form) of bit masks."""
    return (sets[..., None] >> np.arange(len(NAMES)) & 1).astype(bool)


def to_instants(
    df: DataFrame, *, source: str, key: str, text: str, zone: str | None = None, sure: float = 0.9, unlikely: float = UNLIKELY, distinct: bool = True
) -> DataFrame:
    """One row for each distinct (source, key, text, zone): (source, key, text, utc_us, form, posterior, status).

    status: 'canonical' (already YYYY-MM-DDThh:mm:ssZ), 'converted', 'ambiguous' (several forms fit and none
    has a posterior of sure; utc_us is null), 'zone' (a wall time whose zone is unknown; null), 'none' (no
    instant; null). unlikely is the logarithm of the prior of the unusual order of day and month: by default
    the usual order wins wherever it is a date; at 0 the source's other texts decide, or nothing does.
    A text without a zone is wall time of zone (an IANA name), or UTC if that is null; an hour that occurs
    twice is meant the first time, one that never occurs moves on by the gap. Finer digits than microseconds
    are dropped. A null source is a source of its own; null and empty texts are 'none', blanks around a text
    and its length don't matter; an empty table gives an empty result; other columns are ignored. Without
    distinct, repeated rows may be repeated in the result.

    Only counts of form sets reach Python, at most a few dozen for a source, many sources at a time.
    """
    spark = df.sparkSession
    zones = [str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds()]
    place = F.col(zone) if zone else F.lit(None).cast("string")
    rows = df.select(F.col(source).alias("source"), F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(place, F.lit("UTC")).alias("_place"))
    known = F.col("_place").isin(zones)
    rows = rows.withColumns({"_known": known, "_place": F.when(known, F.col("_place")).otherwise("UTC")})
    maybe = F.coalesce(F.col("text").rlike(_SEVERAL), F.lit(False))
    plain = _with_forms(rows.filter(~maybe))
    # read once: these are counted, and chosen from
    open_ = cut(_with_forms(rows.filter(maybe)))

    tallies = open_.filter("_set > 0").groupBy("source", "_set").count().groupBy("source").agg(F.collect_list("_set").alias("sets"), F.collect_list("count").alias("counts"))
    tallies = tallies.filter(F.exists("sets", lambda x: F.bit_count(x) > 1))
    kind = rows.schema["source"].dataType.simpleString()

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            shape = len(part), max(map(len, part["sets"]), default=0)
            sets, counts = np.zeros(shape, np.int64), np.zeros(shape)
            for i, (s, n) in enumerate(zip(part["sets"], part["counts"], strict=True)):
                sets[i, : len(s)], counts[i, : len(n)] = s, n
            row, column = np.nonzero(np.bitwise_count(sets) > 1)
            best = fit_mixtures(_valid(sets), counts, unlikely)[row, column]
            yield pd.DataFrame({"source": part["source"].to_numpy(object)[row], "_set": sets[row, column].astype(np.int32), "_form": best.argmax(1).astype(np.int32), "posterior": best.max(1)})

    chosen = tallies.mapInPandas(choose, f"source {kind}, _set int, _form int, posterior double")
    chosen = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    forms = {"_form": F.when(F.col("_set") > 0, F.log2(F.col("_set")).cast("int")), "posterior": F.when(F.col("_set") > 0, 1.0)}
    single = plain.withColumns(forms).unionByName(open_.filter(F.bit_count("_set") < 2).withColumns(forms))
    several = open_.filter(F.bit_count("_set") > 1).withColumn("_salt", F.pmod(F.xxhash64("key", "text"), F.lit(_SALTS)).cast("int"))
    on = (several._set == chosen._set) & (several._salt == chosen._salt) & several.source.eqNullSafe(chosen.source)
    several = several.join(chosen, on).select(*[several[c] for c in plain.columns], "_form", "posterior")

    rows = single.unionByName(several)
    utc = F.get(F.filter("_f", lambda x: x.form == F.col("_form")), F.lit(0)).utc
    unknown = F.col("_shape").isNotNull() & F.col("_zone").isNull() & ~F.col("_known")
    status = F.when(utc.isNull(), "none").when(F.col("posterior") < sure, "ambiguous").when(unknown, "zone").when(F.col("text").rlike(CANONICAL), "canonical").otherwise("converted")
    rows = rows.withColumns({"status": status, "form": F.get(F.array(*map(F.lit, NAMES)), F.col("_form"))})
    value = F.when(F.col("status").isin("canonical", "converted"), utc)
    rows = rows.select("source", "key", "text", value.alias("utc_us"), "form", "posterior", "status")
    return rows.distinct() if distinct else rows
