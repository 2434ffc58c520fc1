"""What the training-data operators share: text access, Arrow helpers and scratch tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialise, packed, quoted, shared_dir, ship

__all__ = ["arrow_map", "benchmark", "by_key", "documents", "free_name", "labels", "materialise", "packed", "quoted", "shared_dir", "ship", "utf8", "values", "whole_text"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, which takes columns by name: those with a dot or a backtick in theirs go by
    another on the way."""
    ship(df.sparkSession)
    names = {c: free_name(df, f"odd_{i}") if "." in c or "`" in c else c for i, c in enumerate(df.columns)}
    plain = df.toDF(*names.values())
    if isinstance(schema, str):
        return plain.mapInArrow(fn, schema)
    inner = T.StructType([T.StructField(names.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields])
    return plain.mapInArrow(fn, inner).toDF(*schema.names)


def by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that exchanges both sides by key: written tables look small to the
    planner, as they are compressed, and would be built whole in the driver to be broadcast."""
    return df.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def whole_text(col: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def values(column: pa.Array, step: int = 256) -> Iterator:
    """A column's Python values, a few hundred at a time: long texts are not all held twice."""
    for i in range(0, len(column), step):
        yield from column.slice(i, step).to_pylist()


def utf8(column: pa.Array) -> Iterator[bytes]:
    """A text column's UTF-8 bytes; null is empty."""
    for x in values(column.cast(pa.binary())):
        yield x or b""
