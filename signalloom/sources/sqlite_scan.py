"""Tables of an SQLite file as DataFrames: ranges of row ids read by tasks, tests answered by SQLite.

The file must lie where driver and executors see it. Joins, groups and orders over the tables are
then Spark's. Tests are an argument, as Spark's own pushing of filters to Python sources can leak
from one query over a frame into the next (see ``paged``); only the named columns are read.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .scratch import ship

#: Rows of one task, about.
ROWS_PER_TASK = 100_000

SIGNS = ("=", "<>", "<", "<=", ">", ">=", "in")


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


@dataclass
class RowIds(InputPartition):
    low: int
    high: int


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.table, self.per_task = options["path"], options["table"], int(options["rows_per_task"])
        self.columns = columns
        self.tests, self.values = [], []
        for column, sign, value in json.loads(options["tests"]):
            listed = value if sign == "in" else [value]
            self.tests.append(f"{_name(column)} {sign} ({', '.join('?' * len(listed))})")
            self.values += listed

    def _rows(self, sql: str, values: list = ()) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(sql, values)

    def partitions(self) -> list[RowIds]:
        [(low, high)] = self._rows(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}")
        if low is None:
            return [RowIds(0, -1)]
        return [RowIds(a, min(a + self.per_task - 1, high)) for a in range(low, high + 1, self.per_task)]

    def read(self, partition: RowIds) -> Iterator[tuple]:
        tests = " AND ".join(["rowid BETWEEN ? AND ?", *self.tests])
        yield from self._rows(f"SELECT {', '.join(map(_name, self.columns))} FROM {_name(self.table)} WHERE {tests}", [partition.low, partition.high, *self.values])


class SqliteSource(DataSource):
    """Options: path, table, columns (JSON: name to Spark type), tests (JSON), rows_per_task."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {kind}" for c, kind in json.loads(self.options["columns"]).items())

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, schema.fieldNames())


def sqlite_scan(spark: SparkSession, path: str, table: str, columns: dict[str, str], tests: Sequence[tuple[str, str, object]] = (), rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The named columns (to Spark types that SQLite's values have) of a table with row ids, of the rows
    that pass all ``tests``: (column, sign, value), a list of values for "in". A null passes none. An
    empty table gives no rows; nulls stay."""
    if any(sign not in SIGNS for _, sign, _ in tests):
        raise ValueError(f"signs are {', '.join(SIGNS)}")
    ship(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").options(path=path, table=table, columns=json.dumps(columns), tests=json.dumps(list(tests)), rows_per_task=str(rows_per_task)).load()
