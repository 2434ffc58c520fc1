"""Context-triggered piecewise hashes of documents (after Kornblum, 2006).

A hash of the last seven bytes ends a chunk wherever it meets a condition set by the block
size, so boundaries depend on nearby content only and come back after an edit. A chunk gives one
character. A fingerprint has the signatures at a block size chosen by length and at its double;
two fingerprints are compared where they share a block size, by the edit distance of the
signatures. Everything per byte is one vectorised pass; chunks are hashed whole.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, materialise, values

WINDOW = 7
LEAST_BLOCK = 3
LENGTH = 64
#: Signatures without a common run of this length are taken for unrelated.
COMMON = 4

_ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
_FACTORS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(WINDOW)], np.uint32)
_RUN = re.compile(r"(.)\1{3,}")


def _window_hashes(data: bytes) -> np.ndarray:
    """A hash of the seven bytes that end at each position."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(1)
    h = b * _FACTORS[0]
    for k in range(1, WINDOW):
        h[k:] += b[:-k] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


def _signature(data: bytes, ends: np.ndarray) -> str:
    """One character for each chunk; the last one covers what follows the last boundary used."""
    cuts = (ends[: LENGTH - 1] + 1).tolist()
    chars, a, view = [], 0, memoryview(data)
    for b in cuts:
        chars.append(_ALPHABET[zlib.crc32(view[a:b]) & 63])
        a = b
    if a < len(data):
        chars.append(_ALPHABET[zlib.crc32(view[a:]) & 63])
    return "".join(chars)


def fingerprint(text: str) -> str:
    """``block:signature:signature at the double block``; an empty text is ``3::``."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return f"{LEAST_BLOCK}::"
    h = _window_hashes(data)
    block, at = LEAST_BLOCK, np.flatnonzero(h % np.uint32(LEAST_BLOCK) == LEAST_BLOCK - 1)
    levels = [at]
    while block * LENGTH < len(data):
        block *= 2
        at = at[h[at] % np.uint32(block) == block - 1]
        levels.append(at)
    # too few chunks: a smaller block, as long as there is one
    while len(levels) > 1 and len(levels[-1]) < LENGTH // 2:
        levels.pop()
        block //= 2
    double = levels[-1][h[levels[-1]] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{_signature(data, levels[-1])}:{_signature(data, double)}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    a, b = _RUN.sub(r"\1\1\1", a), _RUN.sub(r"\1\1\1", b)
    n = min(COMMON, len(a), len(b))
    if {a[i : i + n] for i in range(len(a) - n + 1)}.isdisjoint(b[i : i + n] for i in range(len(b) - n + 1)):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))  # 1 - insertions and deletions / both lengths


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 where no block size or no run of chunks is shared."""
    if a == b:
        return 1.0
    (x, *xs), (y, *ys) = a.split(":"), b.split(":")
    left, right = dict(zip((int(x), 2 * int(x)), xs)), dict(zip((int(y), 2 * int(y)), ys))
    # a double block's signature is empty only for an empty text
    return max((_alike(left[k], right[k]) for k in left.keys() & right.keys() if left[k] and right[k]), default=0.0)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_DIGEST = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_ROWS = pa.schema(_DIGEST + [("part", pa.int32()), ("edge", pa.string()), ("text", pa.string())])
_ROWS_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, part int, edge string, text string"


def _compared(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, other, round(likeness(own, other), 6), round(likeness(own, next_own), 6)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _ordered_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: each is compared with its next; a partition's first row is also returned
    as its head and its last one as open, with their texts."""
    part, before = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), values(batch.column("text"))):
            text = text or ""
            own = fingerprint(text)
            if before is None:
                rows.append((doc_id, None, None, own, None, None, None, part, "head", text))
            else:
                rows.append((*_compared(*before, text, own), part, None, None))
            before = doc_id, text, own
            if len(rows) >= 2000:
                yield _batch(rows, _ROWS)
                rows = []
        yield _batch(rows, _ROWS)
    if before is not None:
        yield _batch([(before[0], None, None, before[2], None, None, None, part, "open", before[1])], _ROWS)


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [values(batch.column(c)) for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")]
        yield _batch([_compared(*row) for row in zip(*cols)], pa.schema(_DIGEST))


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next; the next document is the one of the next smaller doc_id, and the
    first after the last.

    Null text is an empty one; null doc_ids come last, and rows of one doc_id in the order of a
    hash of their texts. A single row is its own next one. Other columns are ignored; an empty
    table gives no rows. One exchange orders the texts by range; only each range's first and
    last rows go through a second, small step.
    """
    keys = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    done = materialise(arrow_map(ordered, _ordered_batches, _ROWS_SQL), "context-hashes")
    # one row per partition, without texts
    parts = done.where("edge = 'head'").select("part")
    first = parts.agg(F.min("part").alias("first"))
    follows = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("following")).crossJoin(F.broadcast(first)).select("part", F.coalesce("following", "first").alias("following"))
    heads = done.where("edge = 'head'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    edges = done.where("edge = 'open'").select("part", "doc_id", "text", "fingerprint").join(follows, "part").join(heads, "following")
    last = arrow_map(edges.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"), _edge_batches, _ROWS_SQL.rsplit(", part", 1)[0])
    return done.where("edge is null").drop("part", "edge", "text").unionByName(last)


def op9_context_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(documents(spark, sf_dir))


QUERIES = {"op9_context_hashing": op9_context_hashing}
ORACLE_SQL: dict[str, str] = {}
