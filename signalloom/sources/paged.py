"""A paged service as a table: a task for each few pages, tests on year and page answered by the source.

The tests are an argument of ``read_pages``: with Spark's own pushing of filters to Python sources a
frame's later queries can meet what an earlier one had pushed, and lose rows. ``register`` makes
the format "pages" known. A service is any class that can be imported where the
tasks run, named as "module:Class" with its arguments as JSON; see ``Service``. ``collect_pages``
takes all pages into a committed table, some at a time: what is committed is never asked for
again, so a run that was paused, or lost, goes on where the last commit ended.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .committed import CommittedTable
from .providers import Paused
from .scratch import ship

SCHEMA = "year int, page int, place int, payload string"
#: Pages that one task asks for.
PAGES_PER_TASK = 4


#: The tests that a source answers.
HOLDS = {"=": lambda x, v: x == v, "in": lambda x, v: x in v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v}


class Service(Protocol):
    def pages(self, year: int) -> int:
        """How many pages a year has, counted from 1."""

    def page(self, year: int, number: int) -> list[dict]:
        """The works of one page, always the same for the same arguments. Raises ``Paused`` if nothing more can be asked now."""


class RecordedPages:
    """Pages that were saved as ``folder/year/number.json``, each a list of works."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def pages(self, year: int) -> int:
        at = os.path.join(self.folder, str(year))
        return max((int(n.removesuffix(".json")) for n in os.listdir(at) if n.endswith(".json")), default=0) if os.path.isdir(at) else 0

    def page(self, year: int, number: int) -> list[dict]:
        at = os.path.join(self.folder, str(year), f"{number}.json")
        if not os.path.exists(at):
            return []
        with open(at, encoding="utf-8") as f:
            return json.load(f)


class AlwaysPaused:
    """A service that is used up: nothing is read, and nothing is lost."""

    def pages(self, year: int) -> int:
        return 1

    def page(self, year: int, number: int) -> list[dict]:
        raise Paused("used up")


def service_of(options: dict) -> Service:
    module, _, name = options["service"].partition(":")
    return getattr(importlib.import_module(module), name)(**json.loads(options.get("arguments", "{}")))


@dataclass
class Pages(InputPartition):
    year: int
    numbers: list[int]


class PagesReader(DataSourceReader):
    """Options: service, arguments (JSON), years (JSON list), done (JSON: year to page numbers), most
    (pages), tests (JSON: see ``read_pages``)."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.tests = json.loads(self.options.get("tests", "[]"))

    def _asked(self, column: str, value: int) -> bool:
        return all(HOLDS[kind](value, v) for c, kind, v in self.tests if c == column)

    def partitions(self) -> list[Pages]:
        service, done = service_of(self.options), json.loads(self.options.get("done", "{}"))
        most = int(self.options.get("most", "0"))
        out, count = [], 0
        for year in json.loads(self.options["years"]):
            if not self._asked("year", year):
                continue
            skip = set(done.get(str(year), ()))
            numbers = [n for n in range(1, service.pages(year) + 1) if n not in skip and self._asked("page", n)]
            if most:
                numbers = numbers[: most - count]
            count += len(numbers)
            out += [Pages(year, numbers[i : i + PAGES_PER_TASK]) for i in range(0, len(numbers), PAGES_PER_TASK)]
        return out or [Pages(0, [])]

    def read(self, partition: Pages) -> Iterator[tuple]:
        """Rows of works, and one without payload for each page, which tells that it was read."""
        service = service_of(self.options)
        for number in partition.numbers:
            try:
                works = service.page(partition.year, number)
            except Paused:
                return
            yield partition.year, number, -1, None
            for place, work in enumerate(works):
                yield partition.year, number, place, json.dumps(work, ensure_ascii=False)


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    ship(spark)
    spark.dataSource.register(PagesSource)


def read_pages(spark: SparkSession, service: str, arguments: dict, years: list[int], done: dict[int, list[int]] | None = None, most: int = 0, tests: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """(year, page, place, payload): works as JSON, and for each page a row of place -1 without payload.

    ``tests`` are (column, sign, value) on year and page, with a sign of ``HOLDS``: pages that fail
    one are never asked for. So aren't those of ``done``, nor more than ``most``."""
    if any(c not in ("year", "page") or sign not in HOLDS for c, sign, _ in tests):
        raise ValueError("tests are on year and page")
    register(spark)
    options = {"service": service, "arguments": json.dumps(arguments), "years": json.dumps(years), "done": json.dumps({str(y): p for y, p in (done or {}).items()}), "most": str(most), "tests": json.dumps(list(tests))}
    return spark.read.format("pages").options(**options).load()


def collect_pages(table: CommittedTable, service: str, arguments: dict, years: list[int], pages_at_once: int = 200) -> bool:
    """Takes the service's pages that the table lacks, ``pages_at_once`` to a commit; True when it has all.

    Ends early, with False, when a round brings no page because the service paused."""
    spark = table.spark
    asked = service_of({"service": service, "arguments": json.dumps(arguments)})
    while True:
        known = table.read()
        done: dict[int, list[int]] = {}
        if known is not None:
            for r in known.where("place = -1").groupBy("year").agg(F.collect_set("page").alias("pages")).collect():
                done[r.year] = sorted(r.pages)
        lacking = sum(asked.pages(y) - len(done.get(y, [])) for y in years)
        if lacking <= 0:
            return True
        before = sum(map(len, done.values()))
        table.append(read_pages(spark, service, arguments, years, done, pages_at_once))
        if table.read().where("place = -1").count() == before:
            return False


def collected_works(table: CommittedTable, schema: str, key: str = "doc_id", quota: int | None = None) -> DataFrame:
    """The works of a collected table with columns of the schema: of each key the first by year, page
    and place, and of each year the first ``quota`` of those."""
    rows = table.read().where("payload is not null").select("year", "page", "place", F.from_json("payload", schema).alias("w"))
    first = rows.groupBy(F.col(f"w.{key}").alias("k")).agg(F.min(F.struct("year", "page", "place", "w")).alias("r")).select("r.*")
    if quota is not None:
        w = Window.partitionBy("year").orderBy("page", "place")
        first = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= quota)
    return first.select("w.*")
