"""What the engine asks of the outside: search, encoding, judgement; and offline stand-ins."""

from __future__ import annotations

import json
import os
import sqlite3
import threading
import time
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import has_quality, matches_query
from ..functions.texts import query_variants, title_and_abstract
from ..operators.sampling import allocate, quota_sample, seeded_subsample
from .committed import CommittedTable
from .scratch import materialise


class SearchProvider(Protocol):
    def search(self, query: str, limit: int, years: list[int], require_references: bool = True) -> DataFrame: ...

    def by_topic(self, topic_id: Any, limit: int, years: list[int]) -> tuple[DataFrame, int]: ...


class Encoder(Protocol):
    def encode(self, texts: DataFrame, column: str) -> DataFrame: ...


class Judge(Protocol):
    def __call__(self, query: str, works: list[dict]) -> list: ...


class TimeBudget:
    """A deadline; ``stop`` marks that results are partial."""

    def __init__(self, seconds: float = 1800, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock, self.end, self.partial = clock, clock() + seconds, False

    def expired(self) -> bool:
        return self.clock() >= self.end

    def stop(self) -> None:
        self.partial = True


class TableSearch:
    """A search over a table of works: doc_id, title, abstract_text, pub_year, topic_id and, for
    the quality filter, referenced_works_ids. The limit is shared evenly over the years."""

    def __init__(self, works: DataFrame, seed: int = 42) -> None:
        self.works, self.seed = works, seed

    def search(self, query: str, limit: int, years: list[int], require_references: bool = True) -> DataFrame:
        text = title_and_abstract(F.col("title"), F.col("abstract_text"))
        found = self.works.where(F.col("pub_year").isin(*years) & matches_query(text, F.lit(query)))
        if require_references and "referenced_works_ids" in self.works.columns:
            found = found.where(has_quality(F.col("abstract_text"), F.col("referenced_works_ids")))
        shares = allocate(spark_years(self.works, years).withColumn("one", F.lit(1)), limit, "year", "one")
        return quota_sample(found, "pub_year", "doc_id", shares.select(F.col("year").alias("pub_year"), "quota"), self.seed)

    def by_topic(self, topic_id: Any, limit: int, years: list[int]) -> tuple[DataFrame, int]:
        """Up to ``limit`` works of a topic, and how many there are."""
        found = self.works.where((F.col("topic_id") == topic_id) & F.col("pub_year").isin(*years))
        return seeded_subsample(found, "doc_id", limit, self.seed), found.count()

    def count_by_year(self, topic_id: Any) -> DataFrame:
        return self.works.where(F.col("topic_id") == topic_id).groupBy("pub_year").count()


def spark_years(works: DataFrame, years: list[int]) -> DataFrame:
    return works.sparkSession.createDataFrame([(y,) for y in years], "year int")


def searches(spark: SparkSession, query: str) -> list[tuple[str, bool]]:
    """What is asked for a query, in order: itself, then its beginnings, each first of works with
    references and then of all. A handful of rows."""
    widened = spark.range(1).select(F.posexplode(query_variants(F.lit(query))).alias("at", "asked"))
    rows = widened.select("at", "asked", F.explode(F.array(F.lit(True), F.lit(False))).alias("references"))
    return [(query, False), *((r.asked, r.references) for r in rows.orderBy("at", F.desc("references")).collect())]


def recover_seeds(query: str, years: list[int], provider: SearchProvider, spark: SparkSession, limit: int = 300, enough: int = 10, most: int = 100, budget: TimeBudget | None = None) -> DataFrame:
    """(doc_id, attempt): up to ``most`` works that match the whole query, each by the first of the
    ``searches`` that finds it. Searches end when ``enough`` works are found or the budget is used
    up. What is found is written once per search, never collected. A provider with ``whole(query)``,
    as one over a term index, says itself what matches; else the found works' texts do."""
    of_whole = provider.whole(query) if hasattr(provider, "whole") else None
    whole = matches_query(title_and_abstract(F.col("title"), F.col("abstract_text")), F.lit(query))
    found = None
    for attempt, (asked, references) in enumerate(searches(spark, query)):
        if budget and budget.expired():
            budget.stop()
            break
        hits = provider.search(asked, limit, years, references)
        hits = hits.where(whole) if of_whole is None else hits.join(of_whole, "doc_id", "left_semi")
        hits = hits.select("doc_id", F.lit(attempt).alias("attempt"))
        found = materialise((hits if found is None else found.unionByName(hits)).groupBy("doc_id").agg(F.min("attempt").alias("attempt")), "seeds")
        if found.count() >= enough:
            break
    if found is None:
        return spark.createDataFrame([], "doc_id string, attempt int")
    return found.orderBy("attempt", "doc_id").limit(most)


def read_through(keys: DataFrame, cache: CommittedTable, key: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows for keys: those that the cache lacks are fetched and committed to it first, so each
    is fetched once. Keys for which nothing is found are asked for again the next time. A null key
    has no rows."""
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    known = cache.read()
    missing = asked if known is None else asked.join(known.select(key), key, "left_anti")
    if not missing.isEmpty():
        cache.append(fetch(missing))
    found = cache.read()
    return asked if found is None else found.join(asked, key, "left_semi")


def sqlite_table(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """The rows of a small control database on the driver."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return spark.createDataFrame(db.execute(query).fetchall(), schema)


def environment(path: str | None) -> dict[str, str]:
    """NAME=value lines of a file, if there is one, under what the process' environment has."""
    found: dict[str, str] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            lines = [x.strip().removeprefix("export ").partition("=") for x in f if "=" in x and not x.lstrip().startswith("#")]
        found = {k.strip(): v.strip().strip("\"'") for k, _, v in lines}
    return found | dict(os.environ)


def configuration(path: str, key_name: str = "API_KEY", env_file: str | None = None) -> dict:
    """A JSON configuration, with an API key from the environment or a file of it."""
    with open(path, encoding="utf-8") as f:
        return json.load(f) | {"api_key": environment(env_file).get(key_name, "")}


class Answer(Protocol):
    """What a call returns: the status, the headers and the decoded body."""

    status: int
    headers: dict
    body: dict


class Paused(RuntimeError):
    """Nothing more can be asked now; what was collected stays, and a later run resumes."""


class RateLimitedClient:
    """A driver-side client for several threads: at most ``rate`` calls a second together.

    ``call(url, params)`` does the request. Network errors and statuses from 500 are tried again
    after growing waits. It pauses at its own ``quota`` of calls, when the service says that no
    more than ``reserve`` calls are left, and when the service refuses (401, 403, 429); any other
    status but 200 is an error."""

    def __init__(self, call: Callable[[str, dict], Answer], rate: float = 5, retries: int = 6, quota: int | None = None, reserve: int = 10, remaining_header: str = "X-RateLimit-Remaining", sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.call, self.gap, self.retries, self.quota, self.reserve, self.sleep, self.clock = call, 1 / rate, retries, quota, reserve, sleep, clock
        self.header = remaining_header.lower()
        self.next, self.used, self.left = 0.0, 0, float("inf")
        self.lock = threading.Lock()

    def _turn(self) -> None:
        """Wait for the next free moment of all threads."""
        with self.lock:
            if self.left <= self.reserve or (self.quota is not None and self.used >= self.quota):
                raise Paused("the allowance is used up")
            now = self.clock()
            at, self.used = max(now, self.next), self.used + 1
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)

    def _note(self, headers: dict) -> None:
        said = next((v for k, v in headers.items() if k.lower() == self.header), None)
        if said is not None:
            with self.lock:
                self.left = min(self.left, float(said))

    def get(self, url: str, **params: Any) -> dict:
        for attempt in range(self.retries):
            if attempt:
                self.sleep(min(2 ** (attempt - 1), 30))
            self._turn()
            try:
                answer = self.call(url, params)
            except OSError:
                continue
            self._note(answer.headers)
            if answer.status in (401, 403, 429):
                raise Paused(f"the service refused: {answer.status}")
            if answer.status == 200:
                return answer.body
            if answer.status < 500:
                raise RuntimeError(f"{url}: status {answer.status}")
        raise Paused("the service can't be reached")
