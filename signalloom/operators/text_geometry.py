"""Where a work's vector lies among the centroids of its topic and of the others' past.

Each year sees only earlier years. Vectors travel as their non-zero entries. A topic's works of a
year are dealt to tasks in bounded pieces and added in place; a topic's yearly sums then meet in
the order of years and give each year's past centroid. The works of a year are compared with that
year's centroids by matrix products: works are cut into parts and centroids into blocks by hashes,
in numbers that follow from their counts, so that whatever the year holds, a task's part and block
hold a bounded number of vectors. ``is_history`` restricts what counts as past (a training set,
say); every work gets its features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import as_year
from ..sources.scratch import materialise, ship
from .history import history_rows
from .labels import expanding_outliers

BUCKETS = 2000
NORM_GUARD = 1e-12
#: Centroids in a block, works in a part and works added in one place, on average: each vector
#: travels once for every block or part of the other side, so they are as large as memory allows.
BLOCK_TOPICS, PART_WORKS, SUM_WORKS = 2048, 16_384, 16_384
#: Works of one matrix product.
BATCH = 256

SPARSE = T.StructType([T.StructField("i", T.ArrayType(T.IntegerType())), T.StructField("x", T.ArrayType(T.DoubleType()))])


def sparse(vector: Column) -> Column:
    """An array's non-zero entries: places i, ascending, and values x."""
    kept = F.filter(F.transform(vector, lambda x, i: F.struct(i.cast("int").alias("i"), x.cast("double").alias("x"))), lambda e: e["x"] != 0)
    return F.when(vector.isNotNull(), F.struct(F.transform(kept, lambda e: e["i"]).alias("i"), F.transform(kept, lambda e: e["x"]).alias("x")))


def hashed_vectors(works: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """works with ``vector``: word counts hashed to buckets, without English stop words, of length
    1, as non-zero entries."""
    tokens = RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=r"(?U)\b\w\w+\b", gaps=False)
    rest = StopWordsRemover(inputCol="__tokens", outputCol="__rest")
    counts = HashingTF(inputCol="__rest", outputCol="__counts", numFeatures=buckets)
    unit = Normalizer(inputCol="__counts", outputCol="__unit", p=2.0)
    found = works.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    for stage in (tokens, rest, counts, unit):
        found = stage.transform(found)
    plain = F.unwrap_udt("__unit")  # sparse, its places ascending
    return found.withColumn("vector", F.struct(plain["indices"].alias("i"), plain["values"].alias("x"))).drop("__text", "__tokens", "__rest", "__counts", "__unit")


def _entries(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each vector and their end, places, values) of a column of sparse vectors."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    i, x = array.field("i"), array.field("x")
    starts = np.append(0, np.cumsum(np.diff(i.offsets.to_numpy()))) if len(array) else np.zeros(1, np.int64)
    return starts, i.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy(zero_copy_only=False)


def _sparse_column(dense: list[np.ndarray]) -> pa.Array:
    places = [np.flatnonzero(v) for v in dense]
    lists = lambda parts, kind: pa.array([p.tolist() for p in parts], pa.list_(kind))
    return pa.StructArray.from_arrays([lists(places, pa.int32()), lists([v[p] for v, p in zip(dense, places)], pa.float64())], ["i", "x"])


class _Sum:
    """A running sum of sparse vectors, as long as the farthest entry so far."""

    def __init__(self) -> None:
        self.total, self.n = np.zeros(0), 0

    def add(self, places: np.ndarray, values: np.ndarray, n: int) -> None:
        size = int(places.max(initial=-1)) + 1
        if size > len(self.total):
            self.total = np.append(self.total, np.zeros(size - len(self.total)))
        self.total += np.bincount(places, values, len(self.total))
        self.n += n


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (topic, year, piece), in order: one sum of each."""
    at, held = None, _Sum()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], kind), pa.array([at[1]], pa.int32()), _sparse_column([held.total]), pa.array([held.n], pa.int64())], names=["topic_id", "pub_year", "vector", "n"])

    for batch in batches:
        kind = batch.schema.field("topic_id").type
        starts, places, values = _entries(batch.column("vector"))
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("topic_id", "pub_year", "piece"))))
        heads = [k for k, key in enumerate(keys) if not k or key != keys[k - 1]]
        for a, b in zip(heads, [*heads[1:], len(keys)]):
            if keys[a] != at:
                if at is not None:
                    yield row()
                at, held = keys[a], _Sum()
            held.add(places[starts[a] : starts[b]], values[starts[a] : starts[b]], b - a)
    if at is not None:
        yield row()


def _past_batches(years: list[int]):
    """Rows of one topic after another, by year: the mean of those before each of the years."""

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, out = None, _Sum(), []

        def upto(year: int | None) -> None:
            """Centroids for the years after the last one given, up to this one."""
            nonlocal done
            while done < len(years) and (year is None or years[done] <= year):
                if held.n:
                    out.append((at, years[done], held.total / held.n, held.n))
                done += 1

        def flushed() -> pa.RecordBatch:
            topic, year, mean, n = zip(*out)
            norm = [float(np.sqrt(m @ m)) for m in mean]
            return pa.RecordBatch.from_arrays([pa.array(topic, kind), pa.array(year, pa.int32()), _sparse_column(list(mean)), pa.array(norm), pa.array(n, pa.int64())], names=["topic_id", "pub_year", "centroid", "norm", "n"])

        done = 0
        for batch in batches:
            kind = batch.schema.field("topic_id").type
            starts, places, values = _entries(batch.column("vector"))
            for k, (topic, year, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("topic_id", "pub_year", "n")))):
                if topic != at:
                    if at is not None:
                        upto(None)
                    at, held, done = topic, _Sum(), 0
                upto(year)
                held.add(places[starts[k] : starts[k + 1]], values[starts[k] : starts[k + 1]], n)
                if len(out) >= 256:
                    yield flushed()
                    out = []
        if at is not None:
            upto(None)
        if out:
            yield flushed()

    return past


def past_centroids(works: DataFrame, is_history: Column | None = None) -> DataFrame:
    """(topic_id, pub_year, centroid, norm, n): the mean vector of a topic's works of history of
    earlier years, for each year from the topic's second to the corpus' last. vector is sparse."""
    spark, kind, vector = works.sparkSession, works.schema["topic_id"].dataType.simpleString(), SPARSE.simpleString()
    ship(spark)
    valid = works.where(F.expr("topic_id is not null and pub_year is not null and vector is not null") & history_rows(is_history)).select("topic_id", "pub_year", "vector", F.xxhash64("doc_id").alias("h"))
    # how many pieces a topic's year is cut into
    sizes = valid.groupBy("topic_id", "pub_year").agg(_dealt(F.count("*"), SUM_WORKS).alias("pieces"))
    cut = valid.join(sizes, ["topic_id", "pub_year"]).select("topic_id", "pub_year", F.pmod("h", F.col("pieces")).alias("piece"), "vector")
    keys = ["topic_id", "pub_year", "piece"]
    sums = cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_sum_batches, f"topic_id {kind}, pub_year int, vector {vector}, n long")
    # years are few
    years = sorted(r.pub_year for r in works.where("pub_year is not null").select("pub_year").distinct().collect())
    ordered = sums.repartition("topic_id").sortWithinPartitions("topic_id", "pub_year")
    return ordered.mapInArrow(_past_batches(years), f"topic_id {kind}, pub_year int, centroid {vector}, norm double, n long")


def _dense(column: pa.ChunkedArray, width: int, lo: int = 0, hi: int | None = None, entries=None) -> np.ndarray:
    """Vectors lo to hi as rows."""
    starts, places, values = entries or _entries(column)
    hi = len(starts) - 1 if hi is None else hi
    out = np.zeros((hi - lo, width))
    part = slice(starts[lo], starts[hi])
    out[np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1])), places[part]] = values[part]
    return out


def _nearest(works: pa.Table, centroids: pa.Table) -> pa.Table:
    """For a part of a year's works and one block of its centroids: the cosine with the own one,
    and the greatest with any other. Both are sparse until a product needs them."""
    count = works.num_rows if centroids.num_rows else 0
    own, nearest = np.full(count, np.nan), np.empty(count)
    if count:
        mine, theirs = _entries(works.column("vector")), _entries(centroids.column("centroid"))
        width = 1 + max(int(mine[1].max(initial=0)), int(theirs[1].max(initial=0)))
        unit = _dense(None, width, entries=theirs) / centroids.column("norm").to_numpy()[:, None]
        place = {t: i for i, t in enumerate(centroids.column("topic_id").to_pylist())}
        at = np.array([place.get(t, -1) for t in works.column("topic_id").to_pylist()])
        for i in range(0, count, BATCH):
            sims = _dense(None, width, i, min(i + BATCH, count), mine) @ unit.T
            rows = np.flatnonzero(at[i : i + BATCH] >= 0)
            own[i + rows] = sims[rows, at[i + rows]]
            sims[rows, at[i + rows]] = -np.inf
            nearest[i : i + BATCH] = sims.max(axis=1)
    return pa.table({"doc_id": works.column("doc_id").slice(0, count), "own": own, "nearest": nearest})


def _dealt(counted: Column, size: int) -> Column:
    """In how many pieces of about that size so many rows are cut."""
    return F.ceil(counted / F.lit(size)).cast("int")


def text_geometry(works: DataFrame, is_history: Column | None = None) -> DataFrame:
    """(doc_id, pub_year, topic_id, novelty_raw, topic_centroid_similarity, cluster_density,
    topic_local_volume, nearest_topic_similarity, cross_topic_gap, is_outlier_cluster).

    works has doc_id, topic_id, pub_year and ``vector`` (of length 1: an array of numbers, or its
    non-zero entries, see ``sparse``), and what ``is_history`` names. Centroids, volumes and the outlier threshold come from works of history
    with a topic only. Works without topic get the nearest centroid only; the first year, years in
    which no work has a topic, and works without year keep the defaults: novelty 1, all else 0. So
    do works without doc_id; those that repeat one share the greatest of their similarities.
    """
    if not isinstance(works.schema["vector"].dataType, T.StructType):
        works = works.withColumn("vector", sparse(F.col("vector")))
    flagged = works.withColumn("__history", F.coalesce(history_rows(is_history), F.lit(False)))
    works = flagged.withColumn("pub_year", as_year(F.col("pub_year"))).select("doc_id", "topic_id", "pub_year", "vector", F.col("__history").alias("history"))
    doc = dict(works.dtypes)["doc_id"]
    centroids = past_centroids(works, F.col("history"))
    usable = centroids.where(F.col("norm") > NORM_GUARD).select("pub_year", "topic_id", "centroid", "norm")
    # years are few: how many pieces each side has is a small table
    topics = usable.groupBy("pub_year").agg(F.count("*").alias("centroids"))
    sizes = works.where("pub_year is not null").groupBy("pub_year").agg(F.count("vector").alias("works"), F.count("topic_id").alias("placed")).where("placed > 0")
    pieces = sizes.join(topics, "pub_year", "left").select("pub_year", "centroids", _dealt(F.col("works"), PART_WORKS).alias("parts"), _dealt(F.col("centroids"), BLOCK_TOPICS).alias("blocks"))
    piece = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = works.where("vector is not null").join(F.broadcast(pieces.where("blocks > 0")), "pub_year").select("pub_year", "doc_id", "topic_id", "vector", piece("doc_id", "parts").alias("part"), every("blocks").alias("block"))
    right = usable.join(F.broadcast(pieces), "pub_year").select("pub_year", "topic_id", "centroid", "norm", piece("topic_id", "blocks").alias("block"), every("parts").alias("part"))
    keys = ["pub_year", "block", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest, f"doc_id {doc}, own double, nearest double")
    best = near.groupBy("doc_id").agg(F.max("nearest").alias("nearest"), F.max(F.nanvl("own", F.lit(-9.0))).alias("own"))

    rows = works.select("doc_id", "topic_id", "pub_year", "history")
    past = centroids.select("topic_id", "pub_year", "norm", F.col("n").alias("past"))
    joined = rows.join(past, ["topic_id", "pub_year"], "left").join(F.broadcast(pieces.select("pub_year", "centroids", "parts")), "pub_year", "left").join(best, "doc_id", "left")
    bound = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    has_own = F.coalesce(F.col("own") > -9.0, F.lit(False))
    similarity = F.when(has_own, bound(F.col("own"))).otherwise(0.0)
    others = F.coalesce(F.col("centroids") >= 2, F.lit(False))
    nearest = F.when(others & (F.col("nearest") > float("-inf")), bound(F.col("nearest"))).otherwise(0.0)
    found = joined.select(
        "doc_id",
        "topic_id",
        "pub_year",
        F.when(has_own, 1 - similarity).otherwise(1.0).alias("novelty_raw"),
        similarity.alias("topic_centroid_similarity"),
        F.coalesce("norm", F.lit(0.0)).alias("cluster_density"),
        F.coalesce("past", F.lit(0)).cast("double").alias("topic_local_volume"),
        nearest.alias("nearest_topic_similarity"),
        F.when(others, similarity - nearest).otherwise(0.0).alias("cross_topic_gap"),
        (F.col("history") & F.col("topic_id").isNotNull()).alias("history"),
        F.col("parts").isNotNull().alias("placed"),
    )
    found = materialise(found, "geometry")  # read for the thresholds and for the rows
    marked = expanding_outliers(found, "novelty_raw", 0.95, "is_outlier_cluster", F.col("history"))
    return marked.withColumn("is_outlier_cluster", F.when(F.col("placed"), F.col("is_outlier_cluster")).otherwise(0)).drop("history", "placed")
