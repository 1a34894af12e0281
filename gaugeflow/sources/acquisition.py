"""Remote products: backends that search and download, and a sync that fetches what isn't there yet."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.operators.joins import split_by_presence
from gaugeflow.sources.settings import SettingsError
from gaugeflow.sources.weather import with_retries

PRODUCT = "product_id string, start timestamp, end timestamp, path int, url string"


@dataclass(frozen=True)
class Backend:
    """search(filters) -> rows of PRODUCT as tuples; download(url, target) -> path. Both must be picklable."""

    name: str
    search: Callable[[Mapping[str, Any]], Sequence[tuple]]
    download: Callable[[str, str], str]
    credentials: tuple[str, ...] = ()


def search_eodag(filters: Mapping[str, Any]) -> list[tuple]:
    """Products of the eodag client; newer versions call a product type a collection."""
    import eodag

    given = dict(filters)
    if int(eodag.__version__.split(".")[0]) >= 4 and "productType" in given:
        given["collection"] = given.pop("productType")
    found = eodag.EODataAccessGateway().search_all(**given)
    return [(p.properties["id"], p.properties.get("startTimeFromAscendingNode"), p.properties.get("completionTimeFromAscendingNode"), None, p.location) for p in found]


def search_asf(filters: Mapping[str, Any]) -> list[tuple]:
    """Products of the asf_search client."""
    import asf_search

    found = asf_search.search(**filters)
    return [(p.properties["sceneName"], p.properties["startTime"], p.properties["stopTime"], p.properties["pathNumber"], p.properties["url"]) for p in found]


def fetch(url: str, target: str) -> str:
    """Download to target by way of a file beside it, so that a broken transfer leaves none."""
    import shutil
    import urllib.request

    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with urllib.request.urlopen(url, timeout=60) as source, open(f"{target}.part", "wb") as out:  # noqa: S310 the backend's url
        shutil.copyfileobj(source, out)
    os.replace(f"{target}.part", target)
    return target


BACKENDS = {b.name: b for b in (Backend("eodag", search_eodag, fetch), Backend("asf", search_asf, fetch, ("ASF_USERNAME", "ASF_PASSWORD")))}


def backend(name: str, known: Mapping[str, Backend] = BACKENDS, environment: Mapping[str, str] = os.environ) -> Backend:
    """The backend of a name; raises for an unknown one, or if its credentials aren't in the environment."""
    if name not in known:
        raise SettingsError(f"no backend {name}; there are {sorted(known)}")
    if lacking := [c for c in known[name].credentials if not environment.get(c)]:
        raise SettingsError(f"{name} needs {', '.join(lacking)}")
    return known[name]


def look_back(today: dt.date, days: int = 3) -> tuple[dt.date, dt.date]:
    """(start, end) of the days up to today; today is a parameter, so that a run can be repeated."""
    if days < 0:
        raise SettingsError("a look-back can't be negative")
    return today - dt.timedelta(days=days), today


def target_folder(root: str, target: str) -> str:
    """target, below root if it is relative."""
    return target if target.startswith("/") or "://" in target else f"{root.rstrip('/')}/{target}"


def found_products(spark: SparkSession, source: Backend, filters: Mapping[str, Any]) -> DataFrame:
    """The products of a search, one row for each id."""
    rows = with_retries(lambda: list(source.search(filters)), lambda e: isinstance(e, OSError))
    return spark.createDataFrame(rows, PRODUCT).dropDuplicates(["product_id"])


def download_missing(products: DataFrame, stored: DataFrame, source: Backend, folder: str) -> DataFrame:
    """(product_id, path, error) of the products that stored (product_id) lacks, downloaded by the executors.

    A product that can't be downloaded has an error instead of a path, and is missing at the next run.
    """
    lacking = split_by_presence(products, stored, ["product_id"])[1]

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, url in zip(part["product_id"], part["url"], strict=True):
                try:
                    rows.append((name, with_retries(lambda u=url, n=name: source.download(u, f"{folder}/{n}"), lambda e: isinstance(e, OSError)), None))
                except Exception as error:  # noqa: BLE001 one product's failure is its result
                    rows.append((name, None, str(error)))
            yield pd.DataFrame(rows, columns=["product_id", "path", "error"])

    return lacking.select("product_id", "url").mapInPandas(load, "product_id string, path string, error string")


def sync(spark: SparkSession, sources: Sequence[Mapping[str, Any]], *, area: str, root: str, log: str, today: dt.date, days: int = 3, known: Mapping[str, Backend] = BACKENDS) -> DataFrame:
    """Search each source (backend, target_dir, further filters) over the look-back and download what log lacks.

    log is a table of earlier downloads (product_id, path, error); only those without an error count as there.
    This run's rows are appended to it and returned.
    """
    start, end = look_back(today, days)
    done = None
    for given in sources:
        filters = {k: v for k, v in given.items() if k not in ("backend", "target_dir")}
        tool = backend(given["backend"], known)
        products = found_products(spark, tool, {**filters, "geom": area, "start": start.isoformat(), "end": end.isoformat()})
        try:
            stored = spark.read.parquet(log).filter("error is null").select("product_id")
        except Exception:  # noqa: BLE001 there is no log before the first run
            stored = products.select("product_id").limit(0)
        # a folder of its own: the log that decides what is missing isn't read again once this run is in it
        path = f"{log.rstrip('/')}/run={uuid.uuid4().hex}"
        download_missing(products, stored, tool, target_folder(root, given["target_dir"])).write.parquet(path)
        rows = spark.read.schema("product_id string, path string, error string").parquet(path)
        done = rows if done is None else done.unionByName(rows)
    return done if done is not None else spark.createDataFrame([], "product_id string, path string, error string")
