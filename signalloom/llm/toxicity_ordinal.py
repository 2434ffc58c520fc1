"""Severity of toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigma(w . x - theta_k): one weight vector for all of the ordered thresholds, so
the model says how far a text lies along one scale; the expected severity is the sum of these
probabilities. Features are words and word beginnings, by how often the text has them. The
labels only say toxic or not; a toxic text's grade (1 to 3) is the third of the toxic sample in
which its density of marking words lies, and what marks is learned from the other half of the
sample: no grade is a function of what the model is given of the same text. The model is fitted
on a bounded sample of labelled rows, whose features are made in the tasks; every document is
scored whole.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, labels, materialise, utf8

GRADES = 4
#: Labelled rows that the model is fitted on at most: (clean, toxic), chosen by a hash of doc_id.
SAMPLE = (16_000, 4_000)
#: Features are more frequent in toxic texts, by this likelihood ratio (a chance of about 1 in
#: 100,000) and in so many of them at least; so many are kept.
EVIDENCE, LEAST_TEXTS, FEATURES = 19.0, 3, 4096
#: A feature marks a toxic text if the share of toxic texts with it is so many times the others'.
MARKING = 20
PREFIXES = (4, 5, 6)
#: Words by which frequencies are measured.
RATE = 300
#: A text is rejected from this probability of any toxicity.
REJECT = 0.5
#: A text's weight in counts, in whole parts, so that sums don't depend on their order. Copies share one.
UNIT = 1_000_000
_CACHE_WORDS = 150_000

_SPACED = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(_SPACED).split()


def of_word(word: bytes) -> list[bytes]:
    """The features of a word: itself, and its beginnings."""
    return [word, *(word[:n] + b"*" for n in PREFIXES if len(word) > n)]


class Model:
    """``known``: feature -> column; one weight for each, and ascending thresholds."""

    def __init__(self, known: dict[bytes, int], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.known, self.weights, self.thresholds = known, weights, thresholds
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def columns(self, word: bytes) -> tuple[int, ...]:
        found = tuple(self.known[f] for f in of_word(word) if f in self.known)
        self.cache[word] = found
        return found

    def found(self, text: bytes) -> tuple[list[tuple[int, ...]], int]:
        """The columns of each word that has some, and the number of words."""
        seq = words(text)
        if len(self.cache) > _CACHE_WORDS:
            self.cache = {}
        get, columns = self.cache.get, self.columns
        return [x for x in [columns(w) if x is None else x for w, x in zip(seq, map(get, seq))] if x], len(seq)

    def row(self, text: bytes) -> dict[int, float]:
        """The text's features: column -> value."""
        return feature_row(*self.found(text))

    def above(self, row: dict[int, float]) -> np.ndarray:
        """P(grade > k) for k from 0."""
        s = sum(self.weights[c] * v for c, v in row.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - s, -500, 500)))


def feature_row(found: list[tuple[int, ...]], n: int) -> dict[int, float]:
    """The sparse row of a text of n words: the logarithm of how often a feature is in ``RATE`` words."""
    counts: Counter = Counter(c for x in found for c in x)
    return {c: math.log1p(RATE * k / n) for c, k in counts.items()}


def fit_cumulative(columns: np.ndarray, rows: np.ndarray, data: np.ndarray, grades: np.ndarray, weight: np.ndarray, width: int, rounds: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of greatest penalised likelihood, by Adam on all rows.
    (rows, columns, data) are the sparse matrix's entries."""
    n, k = len(grades), GRADES - 1
    sizes = np.bincount(grades, weights=weight, minlength=GRADES) + 1.0
    share = np.cumsum(sizes)[:-1] / sizes.sum()
    start = np.log(share / (1 - share))
    param = np.concatenate((np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    first, second = np.zeros_like(param), np.zeros_like(param)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        w, gaps = param[:width], np.exp(param[width + 1 :])
        theta = param[width] + np.concatenate(([0.0], np.cumsum(gaps)))
        s = np.bincount(rows, weights=w[columns] * data, minlength=n)
        below = np.concatenate((np.zeros((n, 1)), 1 / (1 + np.exp(np.clip(s[:, None] - theta, -60, 60))), np.ones((n, 1))), axis=1)
        low, high = below[np.arange(n), grades], below[np.arange(n), grades + 1]
        p = np.maximum(high - low, 1e-12)
        ds = weight * (high + low - 1)  # of the log likelihood, by the score
        dtheta = np.zeros(k)
        np.add.at(dtheta, np.minimum(grades, k - 1), np.where(grades < k, weight * high * (1 - high) / p, 0))
        np.add.at(dtheta, np.maximum(grades - 1, 0), np.where(grades > 0, -weight * low * (1 - low) / p, 0))
        tail = np.cumsum(dtheta[::-1])[::-1]
        grad = -np.concatenate((np.bincount(columns, weights=ds[rows] * data, minlength=width) - l2 * w, tail[:1], tail[1:] * gaps))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        param = param - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    gaps = np.exp(param[width + 1 :])
    return param[:width], param[width] + np.concatenate(([0.0], np.cumsum(gaps)))


def ratio(a: float, n: float, b: float, m: float) -> float:
    """The likelihood ratio statistic that a of n texts, against b of m, have a feature more often by chance."""
    if a * m <= b * n:
        return 0.0
    share = (a + b) / (n + m)
    part = lambda x, k: (x * math.log(x / (k * share)) if x else 0.0) + ((k - x) * math.log((k - x) / (k * (1 - share))) if x < k else 0.0)
    return 2 * (part(a, n) + part(b, m)) if share < 1 else 0.0


def sketch(text: bytes) -> int:
    """The least hash of a text's five-word shingles: copies share it."""
    seq = words(text)
    return min(zlib.crc32(b" ".join(seq[i : i + 5])) for i in range(max(1, len(seq) - 4)))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([sketch(t) for t in utf8(batch.column("text"))], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "sketch"])


#: A text's column of counts: its half of the sample, and whether it is toxic.
CELLS = ("clean0", "toxic0", "clean1", "toxic1")


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is, by cell; summed within a batch."""
    for batch in batches:
        cells = np.array(batch.column("fold").to_pylist()) * 2 + np.array(batch.column("toxic").to_pylist())
        weights = batch.column("weight").to_pylist()
        sums: dict[bytes, list[int]] = {}
        for text, cell, weight in zip(utf8(batch.column("text")), cells, weights):
            for f in {f for w in set(words(text)) for f in of_word(w)}:
                sums.setdefault(f, [0, 0, 0, 0])[cell] += weight
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(4))], names=["feature", *CELLS])


def _row_batches(model: Model, marking: tuple[set[int], set[int]]):
    """Each text's sparse row, and its density of what the other half of the sample says marks toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, data, density = [], [], []
            for text, fold in zip(utf8(batch.column("text")), batch.column("fold").to_pylist()):
                found, n = model.found(text)
                row = feature_row(found, n)
                columns.append(list(row))
                data.append(list(row.values()))
                density.append(sum(any(c in marking[fold] for c in x) for x in found) / max(n, 1))
            out = [batch.column(c) for c in ("doc_id", "hash", "toxic", "weight")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(columns, pa.list_(pa.int32())), pa.array(data, pa.list_(pa.float64())), pa.array(density, pa.float64())], names=["doc_id", "hash", "toxic", "weight", "columns", "data", "density"])

    return run


def _below(want: float, have: int) -> float:
    """The share of a uniform hash that holds so many of the rows, but for a chance of about a billionth."""
    return min(1.0, (want + 6 * math.sqrt(want) + 20) / max(have, 1))


def training_rows(docs: DataFrame, labelled: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """The sample (doc_id, hash, toxic, text, sketch, fold, weight), at most ``sample`` (clean,
    toxic) rows, written once, and how many labels of each kind there are.

    Rows are chosen by a hash of doc_id below a bound that the counts give, so no task sees more
    than its share. Of repeated labels the greatest counts; rows without doc_id or label, and
    labels without document, are left out. Texts with the same sketch share one weight."""
    marks = labelled.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / (1 << 30)
    within = lambda factor: F.when(F.col("toxic") == 1, F.lit(_below(factor * sample[1], counts.get(1, 0)))).otherwise(F.lit(_below(factor * sample[0], counts.get(0, 0))))
    # twice the sample is marked, as some labels have no document
    chosen = marks.withColumn("place", place).where(F.col("place") < within(2))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").join(F.broadcast(chosen), "doc_id")
    # the order is decided without the texts; only those of the sample move
    keys = rows.select("doc_id", "hash", "toxic", "place").distinct()
    picked = None
    for t, n in enumerate(sample):
        part = keys.where(F.col("toxic") == t).orderBy("place", "doc_id", "hash").limit(n).select("doc_id", "hash")
        picked = part if picked is None else picked.union(part)
    found = rows.join(F.broadcast(picked), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.min(F.struct("toxic", "text")).alias("x")).select("doc_id", "hash", "x.toxic", "x.text")
    sketched = materialise(arrow_map(found, _sketch_batches, "doc_id long, hash long, toxic int, text string, sketch long"), "labelled")
    sizes = sketched.groupBy("sketch", "toxic").agg(F.count("*").alias("copies"))
    weighted = sketched.join(F.broadcast(sizes), ["sketch", "toxic"])
    return weighted.select("doc_id", "hash", "toxic", "text", "sketch", F.pmod(F.xxhash64("sketch", F.lit(3)), F.lit(2)).cast("int").alias("fold"), F.floor(F.lit(UNIT) / F.col("copies")).alias("weight")), counts


def feature_evidence(rows: DataFrame) -> tuple[list, np.ndarray]:
    """The features kept, as (feature, counts by cell), by evidence, and the cells' weights."""
    every = rows.groupBy("fold", "toxic").agg(F.sum("weight").alias("w")).collect()
    cells = np.zeros(4)
    for r in every:
        cells[2 * r.fold + r.toxic] = r.w / UNIT
    n0, n1 = float(max(cells[0] + cells[2], 1)), float(max(cells[1] + cells[3], 1))
    counts = arrow_map(rows.select("text", "toxic", "fold", "weight"), _count_batches, "feature binary, " + ", ".join(f"{c} long" for c in CELLS)).groupBy("feature").agg(*(F.sum(c).alias(c) for c in CELLS))
    a, b = (F.col("toxic0") + F.col("toxic1")) / UNIT, (F.col("clean0") + F.col("clean1")) / UNIT
    share = (a + b) / (n0 + n1)
    log = lambda x, k, p: F.when(x > 0, x * F.log(x / (k * p))).otherwise(0.0)
    part = lambda x, k: log(x, k, share) + log(k - x, k, 1 - share)
    evidence = F.when((a * n0 > b * n1) & (share < 1), 2 * (part(a, n1) + part(b, n0))).otherwise(0.0)
    kept = counts.where(a >= LEAST_TEXTS).withColumn("evidence", F.round(evidence, 6)).where(F.col("evidence") >= EVIDENCE)
    best = kept.orderBy(F.desc("evidence"), "feature").limit(FEATURES).collect()
    return [(bytes(r.feature), np.array([r[c] / UNIT for c in CELLS])) for r in best], cells


def train(docs: DataFrame, labelled: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    """Fit on at most ``sample`` (clean, toxic) labelled documents (labelled: doc_id, toxic 0 or 1;
    see ``training_rows``). The driver gets the kept features and the sample's sparse rows, never
    texts. Without labelled documents of both kinds the model finds no text toxic."""
    rows, counts = training_rows(docs, labelled, sample)
    features, cells = feature_evidence(rows)
    none = Model({}, np.zeros(0), np.full(GRADES - 1, 20.0) + np.arange(GRADES - 1))
    if not features:
        return none
    known = {f: i for i, (f, _) in enumerate(features)}
    model = Model(known, np.zeros(len(known)), np.zeros(GRADES - 1))
    marking = []
    for fold in (0, 1):  # what marks a text of one half is learned from the other
        clean, toxic = 2 * (1 - fold), 2 * (1 - fold) + 1
        marking.append({i for i, (_, n) in enumerate(features) if n[toxic] / max(cells[toxic], 1) > MARKING * n[clean] / max(cells[clean], 1)})
    got = arrow_map(rows.drop("sketch"), _row_batches(model, tuple(marking)), "doc_id long, hash long, toxic int, weight long, columns array<int>, data array<double>, density double").orderBy("doc_id", "hash").collect()
    y = np.array([r.toxic for r in got], np.int64)
    density = np.array([r.density for r in got])
    grades = np.zeros(len(y), np.int64)
    grades[y == 1] = 1 + np.searchsorted(np.quantile(density[y == 1], [1 / 3, 2 / 3]), density[y == 1], side="right")
    index = np.repeat(np.arange(len(y)), [len(r.columns) for r in got])
    columns = np.fromiter((c for r in got for c in r.columns), np.int64, len(index))
    data = np.fromiter((v for r in got for v in r.data), np.float64, len(index))
    prior = min(max(counts.get(1, 0) / sum(counts.values()), 0.01), 0.99)
    own = np.array([r.weight for r in got], float)
    weight = np.where(y == 1, prior / own[y == 1].sum(), (1 - prior) / max(own[y == 0].sum(), 1)) * own
    model.weights, model.thresholds = fit_cumulative(columns, index, data, grades, weight, len(known))
    model.cache = {}
    return model


_OUT = "doc_id long, text_hash long, severity double, grade int, p_toxic double, toxic boolean"


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.array([model.above(model.row(t)) for t in utf8(batch.column("text"))]).reshape(-1, GRADES - 1)
            cols = [pa.array(np.round(above.sum(axis=1), 6)), pa.array((above >= 0.5).sum(axis=1).astype(np.int32)), pa.array(np.round(above[:, 0], 6)), pa.array(above[:, 0] >= REJECT)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *cols], names=["doc_id", "text_hash", "severity", "grade", "p_toxic", "toxic"])

    return run


def severity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, severity (expected grade, 0 to 3), grade,
    p_toxic, toxic (rejected). Null text is an empty one, which no feature marks. Repeated rows
    each return a row, a null doc_id stays null, other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return arrow_map(rows, _score_batches(model), _OUT)


def _keep_batches(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(model.above(model.row(t))[0] < REJECT) for t in utf8(batch.column(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rejected rows; columns, whatever their names, and repeats stay as they are.
    Null and empty texts are never rejected; an empty table stays one."""
    return arrow_map(docs, _keep_batches(model, text_col), docs.schema)


def op8_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return severity(docs, train(docs, labels(spark, sf_dir))).drop("text_hash")


QUERIES = {"op8_toxicity_ordinal": op8_toxicity_ordinal}
ORACLE_SQL: dict[str, str] = {}
