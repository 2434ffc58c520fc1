"""How the words of each source of a language differ from those of its other sources.

Texts are cut into terms as bytes: a lookup table over a batch's joined UTF-8 buffers says which
bytes belong to a term and lower-cases A-Z, and boundaries are where that changes or a document
ends. XXH64 groups the slices, and a group is kept only if all of its slices have the bytes of its
first. Counts leave a batch as one row for each source and term.

The divergence of two sources sums over all kept terms, though most don't occur in both. Terms
are dealt to cells of bounded size, each of which holds its entries as a sparse matrix by source
and the list of the language's sources; a sum over all of a cell's terms is one over the entries
(``add.reduceat`` by source) plus one over the distinct values. All numbers are exact integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, documents, materialise

#: A language keeps the terms of so many of its documents.
LEAST_DOCS = 10
#: Terms reported for a source.
TOP_TERMS = 10
SCALE = 1_000_000_000
#: Entries of a cell, on average.
CELL_ENTRIES = 1 << 14

#: Bytes of text that are cut into terms at once; a longer document is taken in pieces.
_PIECE = 1 << 21

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 0x41) & (_BYTE <= 0x5A)
_IN_TERM = _UPPER | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)


def _slices(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of joined texts; none goes over a text's start."""
    member = _IN_TERM[buf]
    opens = member.copy()
    opens[1:] &= ~member[:-1]
    first = doc_starts[doc_starts < len(buf)]
    opens[first] = member[first]
    closes = np.ones(len(buf), bool)
    closes[:-1] = ~member[1:]
    closes[first[first > 0] - 1] = True
    return np.flatnonzero(opens), np.flatnonzero(closes & member) + 1


def _groups(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term and the terms: grouped by hash, verified by bytes."""
    view, digest = memoryview(buf.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    lengths = ends - starts
    chief = first[number]
    differs = lengths != lengths[chief]
    # every byte beside that of the group's first slice
    alike = np.flatnonzero(~differs)
    n = lengths[alike]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    other = buf[np.repeat(starts[alike], n) + within] != buf[np.repeat(starts[chief[alike]], n) + within]
    if other.any():
        differs[np.repeat(alike, n)[other]] = True
    terms = [bytes(view[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    if differs.any():  # two terms of one hash
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(differs).tolist():
            number[i] = more.setdefault(bytes(view[starts[i] : ends[i]]), len(terms) + len(more))
        terms += more
    return number, terms


def _piece_counts(texts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(owner, term, occurrences, texts) of joined texts, and the terms by number."""
    buf = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, ends = _slices(buf, at[:-1])
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, []
    number, terms = _groups(buf, starts, ends)
    # a sparse matrix of texts by terms, its rows then summed by owner
    text = np.searchsorted(at, starts, "right") - 1
    cell, count = np.unique(text * len(terms) + number, return_counts=True)
    key = np.asarray(owners, np.int64)[cell // len(terms)] * len(terms) + cell % len(terms)
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    occurrences = np.add.reduceat(count[order], heads)
    return key[heads] // len(terms), key[heads] % len(terms), occurrences, np.diff(np.append(heads, len(key))), terms


def _cuts(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that no term goes over."""
    at, buf = 0, np.frombuffer(text, np.uint8)
    while at < len(text):
        end = min(at + _PIECE, len(text))
        while end < len(text):
            outside = np.flatnonzero(~_IN_TERM[buf[end : end + _PIECE]])
            if len(outside):
                end += int(outside[0])
                break
            end = min(end + _PIECE, len(text))
        yield text[at:end]
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [[x or "" for x in batch.column(c).to_pylist()] for c in ("lang", "source")]
        groups: dict[tuple[str, str], int] = {}
        owner = [groups.setdefault(pair, len(groups)) for pair in zip(*names)]
        langs, sources = (pa.array(list(x), pa.string()) for x in zip(*groups)) if groups else (pa.array([], pa.string()),) * 2

        def rows(who, term, n, docs, terms):
            who = pa.array(who)
            return pa.RecordBatch.from_arrays([langs.take(who), sources.take(who), pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(term)), pa.array(n), pa.array(docs)], schema=_COUNTS)

        # an empty term stands for each source, so one without terms is known too
        zeros = np.zeros(len(groups), np.int64)
        yield rows(np.arange(len(groups)), zeros, zeros, zeros, [b""])
        texts = batch.column("text").cast(pa.binary())
        held, whose, size = [], [], 0
        for i, who in enumerate(owner):
            text = texts[i].as_buffer()
            text = text.to_pybytes() if text is not None else b""
            if len(text) > _PIECE:
                counts: Counter[bytes] = Counter()
                for piece in _cuts(text):
                    _, term, n, _, terms = _piece_counts([piece], [0])
                    for k, c in zip(term.tolist(), n.tolist()):
                        counts[terms[k]] += c
                yield rows(np.full(len(counts), who), np.arange(len(counts)), list(counts.values()), np.ones(len(counts), np.int64), list(counts))
                continue
            if size + len(text) > _PIECE:
                yield rows(*_piece_counts(held, whose))
                held, whose, size = [], [], 0
            held.append(text)
            whose.append(who)
            size += len(text)
        if held:
            yield rows(*_piece_counts(held, whose))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the rows that hold it, and for
    every source a row of the empty term with zeros.

    Null languages, sources and texts are empty strings. Repeated rows count each time; other
    columns are ignored. An empty table gives no rows.
    """
    three = docs.select(*(F.col(c).cast("string").alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    each = arrow_map(three, _count_batches, "lang string, source string, term string, n long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _smoothed(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 v)), in wide decimals: a count may pass 9 * 10^9."""
    return F.lit(1) + _div(F.lit(SCALE).cast("decimal(18,0)") * (n + 2).cast("decimal(19,0)"), (total + 2 * v).cast("decimal(20,0)"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _far(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def cell_distances(source: np.ndarray, term: np.ndarray, p: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """The matrix of distances between sources, each summed over all terms of one cell.

    (source, term, p) are the entries, terms numbered without gaps; absent is each source's p of a
    term that it lacks. No terms give zeros.
    """
    count, terms = len(absent), int(term.max()) + 1 if len(term) else 0
    out = np.zeros((count, count), np.int64)
    if not terms:
        return out
    order = np.argsort(source, kind="stable")
    source, term, p = source[order], term[order], p[order]
    starts = np.searchsorted(source, np.arange(count + 1))
    present = np.flatnonzero(np.diff(starts))
    for a in range(count):
        row = np.full(terms, absent[a])
        row[term[starts[a] : starts[a + 1]]] = p[starts[a] : starts[a + 1]]
        found, often = np.unique(row, return_counts=True)
        # as if the other source had none of the terms, then what its entries change
        out[a] = (_distance(found[:, None], absent[None, :]) * often[:, None]).sum(axis=0)
        own = row[term]
        out[a, present] += np.add.reduceat(_distance(own, p) - _distance(own, absent[source]), starts[present])
    return out


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (lang, cell, source, term); a null term is the head of a source."""
    names, kinds = ["lang", "source", "item", "value"], [pa.string()] * 3 + [pa.int64()]
    at, sources, absent, terms = None, [], [], {}
    who, which, p = [], [], []

    def done() -> pa.RecordBatch:
        matrix = cell_distances(np.array(who, np.int64), np.array(which, np.int64), np.array(p, np.int64), np.array(absent, np.int64))
        low, high = np.triu_indices(len(sources), 1)
        name = pa.array(sources, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(low), kinds[0]), name.take(pa.array(low)), name.take(pa.array(high)), pa.array(matrix[low, high])], names=names)

    for batch in batches:
        for lang, cell, source, term, value in zip(*(batch.column(c).to_pylist() for c in ("lang", "cell", "source", "term", "p"))):
            if (lang, cell) != at:
                if at is not None:
                    yield done()
                at, sources, absent, terms, who, which, p = (lang, cell), [], [], {}, [], [], []
            if term is None:
                sources.append(source)
                absent.append(value)
            else:
                who.append(len(sources) - 1)
                which.append(terms.setdefault(term, len(terms)))
                p.append(value)
    if at is not None:
        yield done()
    yield pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names=names)


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for every language and source.

    Part ``pair`` has each other source of the language by its distance, part ``term`` the ``top``
    kept terms that set the source most apart from its language. Kept are the terms of
    ``least_docs`` rows of the language. Null languages, sources and texts are empty strings;
    repeated rows count each time. Sources without terms, and languages without kept ones, have
    pairs too (of value 0 in the latter). Other columns are ignored; an empty table gives no rows.
    """
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs)
    both = counts.select("*", F.sum("n").over(by_term).alias("lang_n"), F.sum("docs").over(by_term).alias("lang_docs"), (F.min("source").over(by_term) == F.col("source")).alias("first"))
    kept = materialise(both.where((F.col("term") == "") | (F.col("lang_docs") >= least_docs)), "kept-terms")
    real = F.col("term") != ""
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"),
        F.sum((F.col("first") & real).cast("long")).alias("v"),
        F.greatest(F.lit(1), F.ceil(F.sum(real.cast("long")) / CELL_ENTRIES)).cast("int").alias("cells"),
    )
    groups = materialise(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(langs, "lang"), "sources")
    v = F.col("v")
    entries = kept.where(real).join(groups, ["lang", "source"]).select("*", _smoothed(F.col("n"), F.col("total"), v).alias("p"), F.expr("cast(pmod(xxhash64(term), cells) as int)").alias("cell"))

    heads = groups.where("v > 0").select("lang", F.explode(F.expr("sequence(0, cells - 1)")).alias("cell"), "source", F.lit(None).cast("string").alias("term"), _smoothed(F.lit(0), F.col("total"), v).alias("p"))
    bare = groups.where("v = 0").select("lang", F.lit(0).alias("cell"), "source", F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("p"))
    cells = heads.unionByName(bare).unionByName(entries.select("lang", "cell", "source", "term", "p"))
    dealt = cells.repartition("lang", "cell").sortWithinPartitions("lang", "cell", "source", F.col("term").asc_nulls_first())
    halves = arrow_map(dealt, _cell_batches, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = halves.select("lang", "value", F.explode(F.array(F.struct("source", F.col("item").alias("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    q = _smoothed(F.col("lang_n"), F.col("lang_total"), v)
    apart = entries.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "p", q.alias("q")).where("p > q").select("lang", "source", "part", "item", _far(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    rank = F.row_number().over(ranked).alias("rank")
    return pairs.select("*", rank).unionByName(apart.select("*", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(documents(spark, sf_dir))


QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL = {
    "op13_source_divergence": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), tokens AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang
), sources AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source
  GROUP BY g.lang, g.source
), smoothed AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v) AS p,
         1 + CAST({SCALE} AS HUGEINT) * (k.lang_n + 2) // (l.lang_total + 2 * l.v) AS q
  FROM sources s JOIN langs l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM smoothed a JOIN smoothed b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM smoothed WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
""",
}
