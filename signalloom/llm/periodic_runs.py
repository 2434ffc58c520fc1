"""Runs of repeated words, found by probing a harmonic grid.

A stretch of period p and length 4p or more holds four grid points jp, (j+1)p, (j+2)p, (j+3)p in
a row, so a word equal to the next three at that distance is the only trace to look for: n/p
points for each p, n log n in all. The few that pass a second probe between the grid points are
extended both ways by comparing arrays in growing chunks. Periods go upwards, and a grid point is
skipped where a run already found reaches beyond its three steps: by the theorem of Fine and Wilf
a stretch there would have that run's shorter period.

Each document is a row of its own and nothing is exchanged. Memory follows the longest document:
a number for each word, each distinct word once.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, documents, utf8, values

#: A run holds its period this often and this many words at least.
LEAST_EXPONENT = 4
LEAST_WORDS = 6

_CELLS = 1 << 20
_PIECE = 1 << 20
_CHUNK = 64, 1 << 16
_SPACE = re.compile(rb"[\t-\r ]")


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word between ASCII white space, equal for equal words, and the words by
    number. A long text is split piece by piece: only its distinct words are held as objects."""
    known: dict[bytes, int] = {}
    found, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + _PIECE) if len(text) - at > _PIECE else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        found.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int32), list(known)


def _agree(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How far from at, in steps of 1 or -1, words keep being equal to those p later."""
    done, size = 0, _CHUNK[0]
    most = len(w) - p - at if step > 0 else at + 1
    while done < most:
        m = min(size, most - done)
        lo = at + done if step > 0 else at - done - m + 1
        other = w[lo : lo + m] != w[lo + p : lo + p + m]
        first = int((other if step > 0 else other[::-1]).argmax())
        if (other if step > 0 else other[::-1])[first]:
            return done + first
        done, size = done + m, min(2 * size, _CHUNK[1])
    return done


def _survivors(w: np.ndarray, low: int, high: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grid point, period) for periods low to high - 1 where four grid points in a row and the
    places between them agree and no run found before reaches beyond them; by period, then place."""
    n = len(w)
    periods = np.arange(low, high, dtype=np.int64)
    grid = periods[:, None] * np.arange((n - 1) // low + 1, dtype=np.int64)
    inside = grid < n
    word = w[np.where(inside, grid, 0)]
    same = (word[:, 1:] == word[:, :-1]) & inside[:, 1:]
    row, j = np.nonzero(same[:, :-2] & same[:, 1:-1] & same[:, 2:])
    p = periods[row]
    s = j * p
    fresh = reach[s] <= s + 3 * p
    s, p = s[fresh], p[fresh]
    for part in (1, 3, 5, 7):
        between = s + part * p // 4
        alike = w[between] == w[between + p]
        s, p = s[alike], p[alike]
    return s, p


def find_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers w, by start, then period: stretches with
    that smallest period, four times or more as long and of six words or more, that no neighbouring
    word extends. No words, or fewer than six, have none."""
    n, runs = len(w), []
    if n < LEAST_WORDS:
        return runs
    reach = np.zeros(n, np.int64)
    low, most = 1, n // LEAST_EXPONENT
    while low <= most:
        # at most twice the least period at once, and a bounded number of grid points
        high = min(2 * low, most + 1, low + max(1, _CELLS * low // n))
        last, end = 0, 0
        for s, p in zip(*(x.tolist() for x in _survivors(w, low, high, reach))):
            if (p == last and s < end) or reach[s] > s + 3 * p:
                continue
            a, b = s - _agree(w, s, p, -1) + 1, s + _agree(w, s, p, 1)
            last, end = p, b
            # only a point whose three steps lie in the stretch has been held against shorter periods
            if s + 2 * p < b and b + p - a >= max(LEAST_WORDS, LEAST_EXPONENT * p):
                runs.append((a, b + p - a, p))
                np.maximum(reach[a : b + p], b + p, out=reach[a : b + p])
        low = high
    return sorted(runs, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length by period; ties go to the smallest start, then period."""
    better = cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2])
    return min(runs, key=better, default=None)


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change)[:n] == 0


def planted(w: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words with a stretch repeated to the end, in the tenth of the documents that a checksum
    of the id picks. One without id stays as it is."""
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([w[:a], w[a + np.arange(n - a) % p]])


def _joined(w: np.ndarray, words: list[bytes], stay: np.ndarray) -> Iterator[bytes]:
    """The words that stay, joined by one space, in pieces."""
    left = w[stay]
    for i in range(0, len(left), _PIECE):
        yield (b" " if i else b"") + b" ".join([words[k] for k in left[i : i + _PIECE].tolist()])


def _digest(doc_id: int | None, text: bytes, plant: bool) -> tuple:
    w, words = word_numbers(text)
    if plant:
        w = planted(w, doc_id)
    runs = find_runs(w)
    listed, left = hashlib.sha256(), hashlib.sha256()
    for run in runs:
        listed.update(b"%d,%d,%d\n" % run)
    for piece in _joined(w, words, kept(len(w), runs)):
        left.update(piece)
    best = strongest(runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *first, listed.hexdigest(), left.hexdigest()


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = "doc_id long, start long, length long, period long"


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    columns = zip(*held) if held else ([] for _ in kinds)
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _digest_batches(plant: bool):
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches((_digest(i, t, plant) for i, t in zip(values(batch.column("doc_id")), utf8(batch.column("text")))), names, kinds)

    return digests


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ((i, *run) for i, t in zip(values(batch.column("doc_id")), utf8(batch.column("text"))) for run in find_runs(word_numbers(t)[0]))
        yield from _batches(found, ["doc_id", "start", "length", "period"], [pa.int64()] * 4)


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period) of every run of each row's words, numbered from 0.

    Null, empty and word-less texts have none; repeated rows each return theirs, and a null doc_id
    stays null. Other columns are ignored. An empty table gives no rows.
    """
    return arrow_map(_two(docs, id_col, text_col), _run_batches, _RUNS)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each run cut to its first period and its words joined by one space.

    Texts without runs stay as they are, white space included; so do null and empty ones. All rows
    and other columns stay. A word goes if any run holds it after that run's first period.
    """

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for raw, null in zip(utf8(batch.column(at)), batch.column(at).is_null().to_pylist()):
                w, words = word_numbers(raw)
                found = find_runs(w)
                texts.append(None if null else b"".join(_joined(w, words, kept(len(w), found))) if found else raw)
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield batch.set_column(at, pa.field(text_col, pa.string()), column)

    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType, True) for f in docs.schema.fields]
    return arrow_map(docs, collapsed, T.StructType(fields))


def run_digests(docs: DataFrame, plant: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its number of runs, the strongest one's start, length, period and
    exponent (nulls if it has none), and digests of all runs and of the collapsed words.

    ``plant`` first repeats a stretch of words in a tenth of the documents. Null, empty and
    word-less texts have no run and the digest of nothing. Repeated rows each return a row; a row
    without doc_id is not planted. Other columns are ignored; an empty table gives no rows.
    """
    return arrow_map(_two(docs, id_col, text_col), _digest_batches(plant), _DIGEST)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(documents(spark, sf_dir), plant=True)


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
#: Runs of any period in whole texts are out of SQL's reach at the tables' size; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
