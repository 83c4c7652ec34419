"""Lookups in public bibliographic services, as a batch data source: DOIs in batches, a partition a batch, retries with back-off.

The transport is a parameter: nothing here opens a connection unless `fetch` does, so that tests and closed clusters can replay; Service
is one that does. fetch_all() keeps answers in a table, within a rate, and goes on where an earlier run stopped.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .merge import KeyedTable

BATCH = 40
RETRIES = 4
Fetch = Callable[[list[str]], tuple[int, dict[str, dict]]]


def with_retries(fetch: Fetch, dois: list[str], wait: Callable[[float], None] = time.sleep) -> tuple[int, dict[str, dict]]:
    """(status, works by DOI); too many requests and server errors are tried again, each time after twice the pause."""
    status, works = 0, {}
    for k in range(RETRIES):
        status, works = fetch(dois)
        if status != 429 and status < 500:
            break
        if k + 1 < RETRIES:
            wait(0.5 * 2**k)
    return status, works


def lookup(dois: DataFrame, fetch: Fetch, concurrency: int = 4, doi: str = "doi", size: int = BATCH) -> DataFrame:
    """Rows (query_doi, http, work JSON) for distinct keys, `size` a request; as many requests at once as there are partitions."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = frame["doi"].tolist()
            for k in range(0, len(names), size):
                status, works = with_retries(fetch, names[k : k + size])
                yield pd.DataFrame([(d, status, json.dumps(works[d]) if d in works else None) for d in names[k : k + size]], columns=["query_doi", "http", "work"])

    distinct = dois.select(F.col(doi).alias("doi")).where("doi is not null").distinct()
    return distinct.repartition(concurrency, "doi").mapInPandas(run, "query_doi string, http int, work string")


def worklist(gaps: DataFrame, most: int) -> DataFrame:
    """The first `most` distinct DOIs of (pub_id, eid, doi, has_gap), publications with gaps first, then by EID."""
    first = gaps.where("doi is not null").groupBy("doi").agg(F.min(F.struct((~F.col("has_gap")).alias("later"), "eid")).alias("at"))
    return first.orderBy("at.later", "at.eid", "doi").limit(most).select("doi")


# ---------------------------------------------------------------- services
#: Keys a request, requests a second, and what is tried again.
LIMITS = {"openalex": (40, 4.0), "crossref": (1, 3.0), "orcid": (1, 4.0)}
RETRY_STATUS = (429, 500, 502, 503, 504)


class Cancelled(Exception):
    """Raised when a run is asked to stop; what was looked up before is kept."""


@dataclass(frozen=True)
class Service:
    """A public service under a base address: `openalex` (DOIs in one query), `crossref` (a DOI a request), `orcid` (identifiers of a
    person). Called with keys it gives (status, records by key), as `Fetch` says; a transport fault is status 0."""

    kind: str
    base: str
    timeout: float = 30.0
    agent: str = "ledgerloom"

    def _get(self, path: str) -> tuple[int, dict | None]:
        request = urllib.request.Request(f"{self.base.rstrip('/')}/{path}", headers={"Accept": "application/json", "User-Agent": self.agent})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return answer.status, json.loads(answer.read())
        except urllib.error.HTTPError as e:
            return e.code, None
        except (OSError, ValueError):
            return 0, None

    def __call__(self, keys: list[str]) -> tuple[int, dict[str, dict]]:
        quote = lambda k: urllib.parse.quote(k, safe="")
        if self.kind == "openalex":
            status, body = self._get(f"works?filter=doi:{quote('|'.join(keys))}&per-page={len(keys)}")
            plain = lambda d: (d or "").lower().removeprefix("https://doi.org/")
            return status, {plain(w.get("doi")): w for w in (body or {}).get("results", []) if plain(w.get("doi")) in keys}
        path = f"works/{quote(keys[0])}" if self.kind == "crossref" else f"{quote(keys[0])}/external-identifiers"
        status, body = self._get(path)
        if body is None:
            return status, {}
        return status, {keys[0]: body.get("message", {}) if self.kind == "crossref" else body}


def tried(fetch: Fetch, keys: list[str], retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> tuple[int, dict[str, dict], int]:
    """(status, records, requests made): faults of the transport and RETRY_STATUS are tried again, after 1, 2, 4 ... seconds."""
    for k in range(retries + 1):
        status, found = fetch(keys)
        if status and status not in RETRY_STATUS or k == retries:
            return status, found, k + 1
        wait(float(2**k))
    raise AssertionError


ANSWER = T.StructType([T.StructField("key", T.StringType()), T.StructField("http", T.IntegerType()), T.StructField("record", T.StringType())])


def ask(keys: DataFrame, fetch: Fetch, lanes: int, size: int, rate: float, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Rows ANSWER of distinct keys (key). There are `lanes` partitions, and each waits lanes / rate seconds after a request, so that
    together they keep to `rate` requests a second, wherever they run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = frame["key"].tolist()
            for k in range(0, len(names), size):
                part = names[k : k + size]
                status, found, _ = tried(fetch, part, wait=wait)
                yield pd.DataFrame([(x, status, json.dumps(found[x], ensure_ascii=False, sort_keys=True) if x in found else None) for x in part], columns=ANSWER.names)
                wait(lanes / rate)

    return keys.select("key").repartition(lanes, "key").mapInPandas(run, ANSWER)


def fetch_all(keys: DataFrame, fetch: Fetch, store: KeyedTable, lanes: int = 3, size: int = BATCH, rate: float = 4.0, round_keys: int = 2000, should_continue: Callable[[], bool] = lambda: True, wait: Callable[[float], None] = time.sleep) -> int:
    """Look up all distinct keys (key) that the store has no answer for; how many were asked.

    Rounds of round_keys keys are asked and merged into the store, which has the columns ANSWER and the key `key`. Before each round
    should_continue() is asked; where it says no, Cancelled is raised. A later run asks only what isn't in the store: what a round that
    failed had asked is asked again. Answers that a service couldn't give (status 0 or RETRY_STATUS) aren't stored.
    """
    asked = 0
    wanted = keys.where("key is not null").select("key").distinct()
    failed: DataFrame | None = None
    while True:
        rest = wanted.join(store.read().select("key"), "key", "left_anti")
        if failed is not None:
            rest = rest.join(failed, "key", "left_anti")
        todo = cut(rest.orderBy("key").limit(round_keys))
        n = todo.count()
        if not n:
            return asked
        if not should_continue():
            raise Cancelled(f"stopped after {asked} keys")
        answers = cut(ask(todo, fetch, lanes, size, rate, wait))
        good = (F.col("http") != 0) & ~F.col("http").isin(*RETRY_STATUS)
        store.merge(answers.where(good))
        bad = answers.where(~good).select("key")
        failed = bad if failed is None else cut(failed.union(bad))  # not again in this run
        asked += n
