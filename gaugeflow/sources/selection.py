"""Which scenes are processed: window, excluded dates, months, orbit path, and summaries of what is there."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.sources.settings import DataError, SettingsError


def _day(text: str | date | None, name: str) -> date | None:
    if text is None or text == "":
        return None
    try:
        return text if isinstance(text, date) else date.fromisoformat(str(text)[:10])
    except ValueError as error:
        raise SettingsError(f"{name} is no date: {text}") from error


def processing_window(scenes: DataFrame, start: str | date | None = None, end: str | date | None = None, *, when: str = "datetime", least_dates: int = 2) -> DataFrame:
    """Scenes whose UTC date lies from start to end, both included; raises if fewer than least_dates dates are left.

    Bounds that are no dates or in the wrong order are errors of the settings. Scenes without a time are left out.
    """
    low, high = _day(start, "start"), _day(end, "end")
    if low and high and low > high:
        raise SettingsError("the window starts after its end")
    day = F.to_date(when)
    kept = scenes.filter(day.isNotNull())
    if low:
        kept = kept.filter(day >= F.lit(low))
    if high:
        kept = kept.filter(day <= F.lit(high))
    if kept.select(day.alias("_d")).distinct().limit(least_dates).count() < least_dates:
        raise DataError(f"at least {least_dates} acquisition dates are required")
    return kept


def without_dates(scenes: DataFrame, excluded: Sequence[str | date], *, when: str = "datetime") -> DataFrame:
    """Scenes of other dates than those excluded; raises if none is left. Scenes without a time stay."""
    days = [_day(d, "an excluded date") for d in excluded]
    if None in days:
        raise SettingsError("an excluded date is empty")
    kept = scenes.filter(~F.coalesce(F.to_date(when).isin(days), F.lit(False))) if days else scenes
    if not kept.limit(1).count():
        raise DataError("no scene remains after dates are excluded")
    return kept


def between(scenes: DataFrame, start: str | None = None, end: str | None = None, *, when: str = "datetime") -> DataFrame:
    """Scenes from start to end as instants, both included; a bound without a zone is UTC (the session's zone)."""
    instant = F.col(when).cast("timestamp")
    if start is not None:
        scenes = scenes.filter(instant >= F.lit(start).cast("timestamp"))
    return scenes.filter(instant <= F.lit(end).cast("timestamp")) if end is not None else scenes


def in_months(scenes: DataFrame, months: Sequence[int], *, when: str = "datetime") -> DataFrame:
    return scenes.filter(F.month(when).isin(list(months)))


def most_frequent(scenes: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column): the value that most scenes have, the least of equally frequent ones; nulls don't count."""
    counts = scenes.filter(F.col(column).isNotNull()).groupBy(*keys, column).count()
    # ascending order of (-count, value)
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(column).alias("v")))["v"].alias(column))


def on_path(scenes: DataFrame, path: int | None = None, column: str = "path") -> DataFrame:
    """Scenes of one orbit path: the given one, else the most frequent."""
    if path is not None:
        return scenes.filter(F.col(column) == path)
    return scenes.join(F.broadcast(most_frequent(scenes, column)), column, "left_semi")  # one row


def subswath_summary(scenes: DataFrame, subswath: str = "subswath", when: str = "datetime") -> DataFrame:
    """(subswath, n, first, last)."""
    return scenes.groupBy(subswath).agg(F.count(F.lit(1)).alias("n"), F.min(when).alias("first"), F.max(when).alias("last"))


def require_increasing(displacement: DataFrame, date_column: str = "date", order: str = "step") -> DataFrame:
    """displacement (one row a date, in the order of order) unless a date is missing, repeated or out of order."""
    rows = displacement.select(F.col(date_column).alias("d"), F.col(order).alias("o"))
    n, dates, lost = rows.agg(F.count(F.lit(1)), F.countDistinct("d"), F.count_if(F.col("d").isNull())).first()
    if lost or dates != n:
        raise DataError("dates are missing or repeated")
    earlier = F.lag("d").over(Window.orderBy("o"))  # one row for each acquisition date
    if rows.withColumn("_e", earlier).filter("d <= _e").limit(1).count():
        raise DataError("dates are not increasing")
    return displacement


#: Folders of a product's bands, finest first.
BAND_FOLDERS = ("R10m", "R20m", "R60m")


def band_order(path: Column) -> Column:
    """(rank, path): the least is a band's finest file; folders that aren't a resolution come last."""
    folder = F.regexp_extract(path, r"/(R\d+m)/[^/]*$", 1)
    place = F.array_position(F.array(*map(F.lit, BAND_FOLDERS)), folder)
    return F.struct(F.when(place > 0, place).otherwise(len(BAND_FOLDERS) + 1).alias("rank"), path.alias("path"))


def product_bands(files: DataFrame, path: str = "path") -> DataFrame:
    """(band, path): a product's band files, each band from the finest folder that has it, else from the product's root."""
    band = F.upper(F.regexp_extract(path, r"_(B\d[0-9A]|SCL|TCI)(?:_\d+m)?\.[^./]+$", 1))
    rows = files.select(band.alias("band"), band_order(F.col(path)).alias("_f")).filter("band != ''")
    return rows.groupBy("band").agg(F.min("_f")["path"].alias("path"))
