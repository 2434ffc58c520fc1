"""A text encoder that is learned from the corpus: the leading directions of its tf-idf matrix.

The directions come from a randomised truncated decomposition (Halko, Martinsson and Tropp, 2011). Each
pass multiplies the matrix of texts by terms and its transpose with a thin block: tasks stream
their sparse rows and send one block of sums, added by an exchange on its rows. The driver holds
terms by directions, which parameters bound, never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise, quoted, ship
from .text_geometry import _entries, sparse

#: Terms are hashed to so many columns; texts become vectors of so many numbers.
TERMS, SIZE = 4096, 64
#: Directions beyond those asked for, and passes that sharpen them.
EXTRA, PASSES = 16, 3
_ROWS = 512


def _counts(texts: DataFrame, column: str, terms: int) -> DataFrame:
    """texts with ``__counts``: sparse counts of hashed words without English stop words."""
    found = texts.withColumn("__text", F.coalesce(quoted(column), F.lit("")))
    for stage in (RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=r"(?U)\b\w\w+\b", gaps=False), StopWordsRemover(inputCol="__tokens", outputCol="__rest"), HashingTF(inputCol="__rest", outputCol="__tf", numFeatures=terms)):
        found = stage.transform(found)
    return found.withColumn("__counts", sparse(vector_to_array("__tf"))).drop("__text", "__tokens", "__rest", "__tf")


def _weighed(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, places, values) of tf-idf rows of length 1; a row without terms is zero."""
    starts, places, values = _entries(column)
    values = values * idf[places]
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    norm = np.sqrt(np.bincount(rows, values**2, len(starts) - 1))
    return starts, places, values / norm[rows]


def _products(starts: np.ndarray, places: np.ndarray, values: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows times the block, a few hundred at a time, with the entries of those rows."""
    for lo in range(0, len(starts) - 1, _ROWS):
        hi = min(lo + _ROWS, len(starts) - 1)
        part = slice(starts[lo], starts[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
        out = np.zeros((hi - lo, block.shape[1]))
        if len(row):
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            out[row[heads]] = np.add.reduceat(values[part, None] * block[places[part]], heads)
        yield out, row, places[part], values[part]


def _passed(rows: DataFrame, idf: np.ndarray, block: np.ndarray, gram: bool) -> np.ndarray:
    """With A the tf-idf matrix: A' A block, or with ``gram`` block' A' A block."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((block.shape[1] if gram else len(idf), block.shape[1]))
        for batch in batches:
            for product, row, place, value in _products(*_weighed(batch.column("__counts"), idf), block):
                if gram:
                    total += product.T @ product
                elif len(row):
                    order = np.argsort(place, kind="stable")
                    heads = np.flatnonzero(np.append(True, np.diff(place[order])))
                    total[place[order][heads]] += np.add.reduceat(value[order, None] * product[row[order]], heads)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used].tolist(), pa.list_(pa.float64()))], names=["i", "x"])

    ship(rows.sparkSession)
    each = rows.select("__counts").mapInArrow(sums, "i int, x array<double>")
    width = block.shape[1]
    added = each.groupBy("i").agg(*(F.sum(F.col("x")[j]).alias(f"x{j}") for j in range(width)))
    out = np.zeros((width if gram else len(idf), width))
    for r in added.collect():
        out[r[0]] = r[1:]
    return out


@dataclass
class TextEncoder:
    """``idf`` by term, ``directions`` (terms by size) and their singular values."""

    idf: np.ndarray
    directions: np.ndarray
    singular: np.ndarray

    def encode(self, texts: DataFrame, column: str, name: str = "vector") -> DataFrame:
        """texts with a vector of length 1 each; one without known terms, or null, is all zeros."""
        ship(texts.sparkSession)

        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for frame in batches:
                column = pa.StructArray.from_arrays([pa.array(list(frame["i"]), pa.list_(pa.int32())), pa.array(list(frame["x"]), pa.list_(pa.float64()))], ["i", "x"])
                parts = [p for p, *_ in _products(*_weighed(column, self.idf), self.directions)]
                out = np.concatenate(parts) if parts else np.zeros((0, self.directions.shape[1]))
                norm = np.linalg.norm(out, axis=1, keepdims=True)
                yield pd.Series(list(np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-12)))

        found = _counts(texts, column, len(self.idf))
        return found.withColumn(name, vectors("__counts")).drop("__counts")


def fit_encoder(texts: DataFrame, column: str, size: int = SIZE, terms: int = TERMS, passes: int = PASSES, seed: int = 42) -> TextEncoder:
    """An encoder of ``size`` numbers from the corpus' texts. Null texts are empty ones. Where the
    corpus has fewer independent directions than ``size``, the rest are zeros."""
    if not 0 < size <= terms:
        raise ValueError("an encoder has at least one direction and no more than terms")
    rows = materialise(_counts(texts.select(quoted(column).alias("text")), "text", terms).select("__counts"), "term-counts")
    n = rows.count()
    idf = np.ones(terms)
    for r in rows.select(F.explode("__counts.i").alias("i")).groupBy("i").count().collect():
        idf[r.i] = np.log((1 + n) / (1 + r["count"])) + 1
    wide = min(size + EXTRA, terms)
    block = np.random.default_rng(seed).normal(size=(terms, wide))
    for _ in range(passes):
        block = np.linalg.qr(_passed(rows, idf, block, False))[0]
    values, turn = np.linalg.eigh(_passed(rows, idf, block, True))
    order = np.argsort(-values)[:size]
    singular = np.sqrt(np.maximum(values[order], 0))
    directions = block @ turn[:, order] * (singular > 1e-9)
    return TextEncoder(idf, directions, singular)
