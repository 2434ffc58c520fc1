"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

How many rows each input partition sends to each shard follows a multivariate hypergeometric
law whose row sums are the partitions' sizes and whose column sums are the shards'. The matrix
is drawn first, from the partitions' counts alone; then each partition permutes its rows and
deals the first of them to shard 0, the next to shard 1 and so on, the rows are exchanged once,
and each shard permutes what it got (Sanders, 1998; Gustedt, 2008). Shards that are large are
permuted in cells of bounded size: a row's cell is the head of its random key, so cells need no
boundary search, and the cells' sizes follow from the matrix without another pass over the data.

All that touches rows is DataFrame functions; the driver holds counts per partition only.
"""

from __future__ import annotations

import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_name, materialise, packed, quoted, whole_text

SHARDS = 24
SEED = 20_240_229
#: Rows of a shard that are permuted together in one task.
CELL_ROWS = 100_000
#: Rows up to which the library's sampler is exact; larger draws use ``hypergeometric``.
LIBRARY_ROWS = 1_000_000_000
#: Partitions whose bounds are sent to the cluster at once.
MATRIX_SLICE = 10_000
#: Matrix entries up to which the matrix is broadcast; above it is joined by partition.
BROADCAST_ENTRIES = 4_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good: inversion about the mode, with the
    probabilities from their exact ratios; what lies 40 deviations out is below a double's reach."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    width = int(40 * math.sqrt(n * (good / total) * (bad / total) * (total - n) / max(total - 1, 1))) + 40
    low, high = max(low, mode - width), min(high, mode + width)
    k = np.arange(low, high, dtype=np.float64)
    ratio = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # P(k + 1) / P(k)
    above = np.cumprod(ratio[mode - low :])
    below = np.cumprod(1 / ratio[: mode - low][::-1])[::-1]
    mass = np.cumsum(np.concatenate((below, [1.0], above)))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def column_draw(rng: np.random.Generator, left: list[int], n: int) -> list[int]:
    """How n draws without replacement from columns of these sizes fall on them."""
    if sum(left) < LIBRARY_ROWS:
        return rng.multivariate_hypergeometric(left, n, method="marginals").tolist()
    drawn, rest = [], sum(left)
    for c in left:
        x = hypergeometric(rng, c, rest - c, n)
        rest, n = rest - c, n - x
        drawn.append(x)
    return drawn


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> list[list[int]]:
    """A random matrix of counts with these sums, as if sum(rows) rows were shuffled uniformly.

    Ranges of rows are halved: what falls on the first half is drawn as a whole, and each half is
    drawn from its own part. So only the few upper draws are of large numbers."""
    if sum(rows) != sum(columns):
        raise ValueError("row and column sums differ")
    rng, out = np.random.default_rng(seed), []
    todo = [(0, len(rows), list(columns))] if rows else []
    upto = np.concatenate(([0], np.cumsum(np.array(rows, dtype=object)))) if rows else [0]
    while todo:
        a, b, left = todo.pop()
        if b - a == 1:
            out.append(left)
            continue
        mid = (a + b) // 2
        first = column_draw(rng, left, int(upto[mid] - upto[a]))
        todo += [(mid, b, [x - y for x, y in zip(left, first)]), (a, mid, first)]
    return out


def written_matrix(spark: SparkSession, parts: list[int], matrix: list[list[int]]) -> DataFrame:
    """(p, bounds): each partition's running sums over the shards, as a written table: a plan that
    reads it stays small however many partitions there are."""
    kind, slices = "array<struct<p: int, bounds: array<long>>>", []
    for i in range(0, max(len(parts), 1), MATRIX_SLICE):
        rows = [{"p": p, "bounds": np.cumsum(x).tolist()} for p, x in zip(parts[i : i + MATRIX_SLICE], matrix[i : i + MATRIX_SLICE])]
        slices.append(materialise(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind))), "matrix"))
    return reduce(DataFrame.union, slices)


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows with the columns ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard).

    Shard sizes differ by at most one and every assignment is equally likely. ``rows`` must be a
    scan, or a table written before: its partitions are read twice and must be the same both
    times; rows beyond those counted, or fewer than counted, stop the job. Within a partition the
    order comes from the row's content, so a task that is run again deals alike; equal rows stand
    for each other. Nulls, empty and long texts take part as any value, and columns may have any
    name: rows travel as one struct. Where rows has a column named shard or slot, the new one gets
    a trailing underscore. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    if shards < 1:
        raise ValueError("shards must be positive")
    counted = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one count per input partition
    sizes = {r["p"]: r["count"] for r in counted}
    total = sum(sizes.values())
    parts = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in parts], shard_sizes(total, shards), seed)
    cells = max(1, total / shards / cell_rows, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) / shards)
    bits = min(30, math.ceil(math.log2(cells)))

    table = written_matrix(spark, parts, matrix)
    dealt = F.expr("size(filter(bounds, b -> b <= pos))")
    key = F.xxhash64(F.lit(seed + 1), "p", "pos")
    cell = F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)

    hashable = [quoted(f.name) for f in rows.schema.fields if not isinstance(f.dataType, T.MapType)]
    placed = packed(rows, order=F.xxhash64(F.lit(seed), *hashable)).sortWithinPartitions("order").withColumn("at", F.monotonically_increasing_id())
    placed = placed.select("row", F.shiftright("at", 33).cast("int").alias("p"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos"))
    small = len(parts) * (shards + 1) <= BROADCAST_ENTRIES
    changed = F.raise_error(F.lit("the input's partitions changed between the count and the exchange; write the input as a table first"))
    placed = placed.join(F.broadcast(table) if small else table, "p", "left").withColumn("to", F.coalesce(dealt, F.lit(shards)))
    placed = placed.withColumn("shard", F.when(F.col("to") < shards, F.col("to")).otherwise(changed.cast("int"))).select("row", "shard", cell.alias("cell"), key.alias("key"), "p", "pos")

    # which shard and cell a position gets is known without the rows
    positions = table.repartition("p").select("p", "bounds", F.explode(F.expr(f"sequence(0L, bounds[{shards - 1}] - 1)")).alias("pos")).select(dealt.alias("shard"), cell.alias("cell"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = positions.groupBy("shard", "cell").agg(F.count("*").alias("expected")).select("shard", "cell", "expected", F.coalesce(F.sum("expected").over(before), F.lit(0)).alias("start"))

    group = Window.partitionBy("shard", "cell")
    ranked = placed.withColumn("rank", F.row_number().over(group.orderBy("key", "p", "pos"))).withColumn("here", F.count("*").over(group))
    slot = F.when(F.col("here") == F.col("expected"), F.col("start") + F.col("rank") - 1).otherwise(changed.cast("long"))
    names = free_name(rows, "shard"), free_name(rows, "slot")
    return ranked.join(starts, ["shard", "cell"]).select("row.*", F.col("shard").cast("int").alias(names[0]), slot.cast("long").alias(names[1]))


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    digest = docs.select("doc_id", (F.octet_length(whole_text()) + 8).cast("long").alias("size"), F.crc32(whole_text()).alias("text_crc32"), F.lit("rows").alias("law"))
    return shuffle_into_shards(digest).withColumn("grown_shard", F.lit(None).cast("int"))


QUERIES = {"op2_hypergeometric_shards": op2_hypergeometric_shards}
ORACLE_SQL: dict[str, str] = {}
