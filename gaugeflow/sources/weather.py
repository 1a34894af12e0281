"""Weather archives: month slices, cache keys, and reads that only fetch what the cache lacks."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts at a request, and seconds to wait after a transient failure and after a full quota.
ATTEMPTS, WAIT_S, QUOTA_WAIT_S = 3, 2.0, 60.0
#: Data older than so many days stays cached, newer for so many seconds.
SETTLED_DAYS, RECENT_S = 30, 3600


def month_slices(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """df with slice_start and slice_end: one row for each calendar month from start to end, both included."""
    months = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    rows = df.withColumn("_m", months)
    return rows.withColumns({"slice_start": F.greatest("_m", start), "slice_end": F.least(F.last_day("_m"), end)}).drop("_m")


def request_key(lat: Column, lon: Column, *rest: Column) -> Column:
    """Hash of a request; places are the same to 8 decimals."""
    return F.sha2(F.concat_ws("|", F.format_number(lat, 8), F.format_number(lon, 8), *[c.cast("string") for c in rest]), 256)


def canonical_key(request: dict) -> str:
    """The same for one request, on the driver: keys sorted, places rounded."""
    rounded = {k: round(v, 8) if k in ("latitude", "longitude") else v for k, v in request.items()}
    return hashlib.sha256(json.dumps(rounded, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def to_fetch(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """Requests (key, slice_end) without a usable cache row (key, fetched_at)."""
    age = (F.unix_micros(now) - F.unix_micros("fetched_at")) / 1e6
    usable = cache.join(requests.select("key", "slice_end"), "key").filter((F.col("slice_end") < F.date_sub(F.to_date(now), SETTLED_DAYS)) | (age <= RECENT_S))
    return requests.join(usable.select("key").distinct(), "key", "left_anti")


def with_retries(call: Callable, transient: Callable[[Exception], bool], quota: Callable[[Exception], bool] = lambda e: False, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep):
    """The result of call; transient errors are tried again after 2, 4, ... s, a full quota after a minute."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if n == attempts or not (transient(error) or quota(error)):
                raise
            sleep(QUOTA_WAIT_S if quota(error) else WAIT_S**n)


def settled(day: date, today: date) -> bool:
    return (today - day).days > SETTLED_DAYS
