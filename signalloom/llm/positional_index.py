"""Benchmark decontamination with a distributed positional inverted index.

The index stores, for each term and document, the ascending list of the term's word positions.
One pass over the texts makes it; for a phrase search it keeps only positions that can lie in
an occurrence: words of the benchmark's vocabulary, inside a run of such words at least as long
as the shortest window that holds the word. Lists are laid out in term order, and a frequent
term's list is split over partitions. A search takes each window's rarest terms, shifts their
lists by the offset in the item, and intersects the shifted lists of all the item's terms in
the documents that the rarest ones leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, benchmark, documents, materialise, utf8, values

WINDOW = 13
#: A document is contaminated from this share of hit words: 20 * n_hit >= n_words.
SHARE = 20
#: Distinct benchmark terms that are sent to the workers as a dictionary; beyond it every word is indexed.
VOCABULARY_TERMS = 500_000
#: Bytes of benchmark text up to which its tables are broadcast.
BROADCAST_BYTES = 16 << 20

#: A-Z to a-z; ASCII other than letters and digits to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seqs = [[w.decode() for w in words(t)] for t in utf8(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(seqs, pa.list_(pa.string()))], names=["item_id", "words"])


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_key, item_id, words) for the items that have words; repeats count once. The key, a
    digest of id and words, keeps items without id apart."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    found = arrow_map(rows, _item_batches, "item_id long, words array<string>").where("size(words) > 0").distinct()
    return found.select(F.md5(F.concat_ws(" ", F.coalesce(F.col("item_id").cast("string"), F.lit("-")), "words")).alias("item_key"), "item_id", "words")


def _kept(ids: np.ndarray, shortest: np.ndarray) -> np.ndarray:
    """Positions inside a run of known words that is long enough for a window with the word."""
    known = ids >= 0
    if not known.any():
        return np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).view(np.int8)))
    length = np.zeros(len(ids) + 1, np.int64)
    for a, b in zip(edges[::2], edges[1::2]):
        length[a:b] = b - a
    at = np.flatnonzero(known)
    return at[length[at] >= shortest[ids[at]]]


_POSTINGS = pa.list_(pa.struct([("term", pa.string()), ("positions", pa.list_(pa.int32()))]))


def _posting_batches(vocabulary: dict[bytes, int] | None, shortest: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = None if vocabulary is None else [w.decode() for w in vocabulary]
        for batch in batches:
            counts, lists = [], []
            for text in utf8(batch.column("text")):
                seq = words(text)
                counts.append(len(seq))
                found: dict[str, list[int]] = {}
                if terms is None:
                    for i, w in enumerate(seq):
                        found.setdefault(w.decode(), []).append(i)
                else:
                    ids = np.fromiter(map(vocabulary.get, seq, repeat(-1)), np.int32, len(seq))
                    at = _kept(ids, shortest)
                    for i, t in zip(at.tolist(), ids[at].tolist()):
                        found.setdefault(terms[t], []).append(i)
                lists.append([{"term": t, "positions": p} for t, p in found.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64()), pa.array(lists, _POSTINGS)],
                names=["doc_id", "text_hash", "n_words", "postings"],
            )

    return run


class PositionalIndex:
    """``rows``: one row per document with its own postings; ``lists``: (term, doc_id, text_hash,
    positions) in term order, both written tables; ``frequency``: (term, occurrences)."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        each = rows.select("doc_id", "text_hash", F.explode("postings").alias("p")).select("p.term", "doc_id", "text_hash", "p.positions")
        self.lists = materialise(each.distinct().repartitionByRange("term", "text_hash").sortWithinPartitions("term", "doc_id"), "lists")
        self.frequency = self.lists.groupBy("term").agg(F.sum(F.size("positions")).alias("occurrences"))


def build_index(docs: DataFrame, items: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> PositionalIndex:
    """Index docs; with ``items`` (from item_words) only what an exact search for them can use.

    Null, empty and word-less texts have no postings but keep their row; rows of one doc_id are told
    apart by their text, repeated ones are indexed each, and an empty table gives an empty index.
    A text's words are held at once: a hundred bytes or so for each."""
    vocabulary, shortest = None, None
    if items is not None:
        need = items.select(F.explode("words").alias("term"), F.least(F.size("words"), F.lit(window)).alias("n")).groupBy("term").agg(F.min("n").alias("n"))
        found = need.limit(VOCABULARY_TERMS + 1).collect()
        if len(found) <= VOCABULARY_TERMS:
            found.sort()
            vocabulary = {r.term.encode(): i for i, r in enumerate(found)}
            shortest = np.array([r.n for r in found], np.int64)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    schema = "doc_id long, text_hash long, n_words long, postings array<struct<term: string, positions: array<int>>>"
    return PositionalIndex(materialise(arrow_map(rows, _posting_batches(vocabulary, shortest), schema), "postings"))


def _seeds(index: PositionalIndex, items: DataFrame, window: int, rarest: int) -> DataFrame:
    """(item_key, offset, term): the rarest terms of each window whose terms all have a list."""
    each = items.select("item_key", F.posexplode("words").alias("offset", "term")).join(index.frequency, "term", "left")
    term = F.struct(F.col("offset"), F.coalesce("occurrences", F.lit(0)).alias("n"), F.col("term"))
    whole = each.groupBy("item_key").agg(F.array_sort(F.collect_list(term)).alias("w"))
    size = f"least({int(window)}, size(w))"
    best = f"slice(array_sort(transform(filter(slice(w, s, {size}), x -> x.n > 0), x -> struct(x.n, x.offset, x.term))), 1, {int(rarest)})"
    # with one rarest term all terms must occur; with k of them a window may lack k - 1
    enough = f"size(filter(slice(w, s, {size}), x -> x.n = 0)) < {int(rarest)}"
    chosen = f"array_distinct(flatten(transform(filter(sequence(1, size(w) - {size} + 1), s -> {enough}), s -> {best})))"
    return whole.select("item_key", F.explode(F.expr(chosen)).alias("x")).select("item_key", "x.offset", "x.term")


def _matched(lists: dict[str, set[int]], seq: list[str], shift: int, slop: int) -> np.ndarray:
    """Whether each term of the item is where the shift puts it, or within slop words of it."""
    none: set[int] = set()
    if not slop:
        return np.fromiter((shift + j in lists.get(w, none) for j, w in enumerate(seq)), bool, len(seq))
    near = range(-slop, slop + 1)
    return np.fromiter((any(shift + j + d in lists.get(w, none) for d in near) for j, w in enumerate(seq)), bool, len(seq))


def _match_batches(window: int, slop: int, missing: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, items, hits, starts = [], [], [], [], []
            cols = [batch.column(c) for c in ("doc_id", "text_hash")]
            for doc, th, candidates, postings in zip(*(c.to_pylist() for c in cols), values(batch.column("candidates"), 16), values(batch.column("postings"), 16)):
                wanted = {w for c in candidates for w in c["words"]}
                lists = {p["term"]: set(p["positions"]) for p in postings if p["term"] in wanted}
                for c in candidates:
                    seq = c["words"]
                    n = min(window, len(seq))
                    hit: set[int] = set()
                    at: set[int] = set()
                    for shift in c["shifts"]:
                        total = np.concatenate(([0], np.cumsum(_matched(lists, seq, shift, slop))))
                        for j in np.flatnonzero(total[n:] - total[:-n] >= n - missing).tolist():
                            at.add(shift + j)
                            hit.update(range(shift + j, shift + j + n))
                    if at:
                        ids.append(doc), hashes.append(th), items.append(c["item_id"]), hits.append(sorted(hit)), starts.append(sorted(at))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(items, pa.int64()), pa.array(starts, ints), pa.array(hits, ints)],
                names=["doc_id", "text_hash", "item_id", "starts", "hits"],
            )

    return run


def matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW, slop: int = 0, missing: int = 0, small: bool = False) -> DataFrame:
    """(doc_id, text_hash, item_id, starts, hits): where windows of the items occur.

    Exact phrases by default. With ``slop`` or ``missing``, proximity matches: all but
    ``missing`` of a window's terms lie within ``slop`` words of where the occurrence of a
    rarest term puts them; such a search needs an index built without ``items``. ``small``:
    the items' size was checked, so they are broadcast. Items without words and documents without
    any of the terms are in no row; an empty index or table of items gives none.
    """
    hint = F.broadcast if small else lambda x: x
    seeds = _seeds(index, items, window, missing + 1)
    pairs = (
        index.lists.join(hint(seeds), "term")
        .select("doc_id", "text_hash", "item_key", F.explode(F.expr("transform(positions, p -> p - offset)")).alias("shift"))
        .groupBy("doc_id", "text_hash", "item_key")
        .agg(F.collect_set("shift").alias("shifts"))
    )
    # a document's lists travel once, to all of its candidate items
    asked = pairs.join(hint(items), "item_key").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "words", "shifts")).alias("candidates"))
    own = index.rows.where("size(postings) > 0").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "postings").dropDuplicates(["d", "h"])
    found = asked.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    schema = "doc_id long, text_hash long, item_id long, starts array<int>, hits array<int>"
    return arrow_map(found.select("doc_id", "text_hash", "candidates", "postings"), _match_batches(window, slop, missing), schema)


def _small(items: DataFrame) -> bool:
    return (items.agg(F.sum(F.expr("aggregate(words, 0L, (n, w) -> n + octet_length(w) + 16)"))).first()[0] or 0) <= BROADCAST_BYTES


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of
    a shorter item whole; a document is contaminated if ``share * n_hit >= n_words`` with a hit.
    Null or empty text has no words and an item without words no windows. Repeated rows each
    return a row; rows that share a doc_id are told apart by their text. A null item_id is
    left out of the list of items, its hits count. Empty tables give no rows or no hits.
    """
    seqs = materialise(item_words(items, item_id, item_text), "items")
    index = build_index(docs, seqs, id_col, text_col, window)
    found = matches(index, seqs, window, small=_small(seqs))
    each = found.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids")
    )
    rows = index.rows.select("doc_id", "text_hash", "n_words")
    both = rows.join(each, rows.doc_id.eqNullSafe(each.d) & (rows.text_hash == each.h), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return both.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.coalesce((F.col("hit") > 0) & (share * F.col("hit") >= F.col("n_words")), F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones; columns and repeats stay as they are. Null, empty and
    word-less texts are never contaminated, a null doc_id is one like any other, and an empty table
    stays one. The keys of those that go are written first: where they are few, their known size lets the planner broadcast them and
    leave the texts in place."""
    bad = contamination(docs, items, id_col, text_col, **options).where("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct()
    bad = materialise(bad.coalesce(8), "contaminated")
    same = docs[id_col].cast("long").eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs[text_col]) == bad["__bad_hash"])
    return docs.join(bad, same, "left_anti")


def op4_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), benchmark(spark, sf_dir)).drop("text_hash")


QUERIES = {"op4_positional_index": op4_positional_index}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = {
    "op4_positional_index": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wi AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(13, len(w)) AS n FROM i WHERE len(w) > 0))
),
wd AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM wi) WHERE len(w) >= n)
),
hit AS (SELECT doc_id, item_id, s, n FROM wd JOIN wi USING (n, phrase)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
