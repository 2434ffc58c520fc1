"""Mutual information of numbers and a class from nearest neighbours (Ross, 2014).

A point's distance is that to its k-th neighbour of its own class; it is held against the number
of points of any class nearer than that. Values go to written range partitions as counts. Within
a partition the neighbours are window functions; each class hands the last and first k points of
a partition on to the parts beside it. Points nearer than a distance are two positions in one
running sum, so no pair of points is ever formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise, quoted, ship
from .ranks import cumulative

#: What stands for a missing value.
MISSING = -999.0
NEIGHBOURS = 3


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1: a series at n + 10, stepped back."""
    x = n + F.lit(10.0)
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8) - 1 / (132 * x**10)
    for i in range(10):
        series = series - 1 / (n + F.lit(float(i)))
    return series


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order, and back."""
    bits = x.view(np.int64)
    return np.where(bits >= 0, bits, np.int64(-(2**63)) - bits)


def _double(i: np.ndarray) -> np.ndarray:
    return np.where(i >= 0, i, np.int64(-(2**63)) - i).view(np.float64)


def farthest_within(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The greatest double h for which h - x, as doubles are subtracted, is below r; x where r is 0.
    Bisection over the doubles: x + r may be off by many of them."""
    x = x + 0.0  # no negative zero
    low, high = _ordered(x), _ordered(np.minimum(x + 2 * r + np.abs(x) * 1e-15 + 1e-300, np.finfo(float).max))
    while True:
        middle = (low & high) + ((low ^ high) >> 1)
        if (middle == low).all():
            return _double(low)
        inside = (_double(middle) - x) < r
        low, high = np.where(inside, middle, low), np.where(inside, high, middle)


def _long(rows: DataFrame, columns: list[str], y: str, missing: float) -> DataFrame:
    """(g, c, x, n): for each column's number g, each class and value, how many rows have it."""
    value = lambda c: F.when(quoted(c).isNull() | F.isnan(quoted(c).cast("double")), F.lit(missing)).otherwise(quoted(c).cast("double") + F.lit(0.0))
    entries = F.array(*(F.struct(F.lit(i).alias("g"), value(c).alias("x")) for i, c in enumerate(columns)))
    each = rows.where(quoted(y).isNotNull()).select(quoted(y).cast("string").alias("c"), F.explode(entries).alias("e")).select("e.g", "c", "e.x")
    return each.where(F.abs("x") < float("inf")).groupBy("g", "c", "x").agg(F.count("*").alias("n"))


def neighbour_information(rows: DataFrame, columns: list[str], y: str, k: int = NEIGHBOURS, missing: float = MISSING) -> DataFrame:
    """(name, information): mutual information in nats of each column and the class y, 0 at least.

    Null and NaN count as the value ``missing``; rows without class and infinite values are left
    out. A class of one row says nothing and is left out; in one of k rows or fewer the farthest
    neighbour counts. Equal values are at distance 0: where k others have it, all that have it count.
    A column without two rows of a class has information 0.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark, order = rows.sparkSession, ["g", "x"]
    counts = _long(rows, columns, y, missing)
    placed = materialise(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "points")
    sizes = placed.groupBy("g", "c").agg(F.sum("n").alias("of_class")).where("of_class > 1")
    kept = placed.join(F.broadcast(sizes), ["g", "c"])  # one row for a column and class

    # more than k copies of a value are as good as k + 1
    own = ["g", "c", "part"]
    points = kept.select(*own, "x", "n", "of_class", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k + 1)).cast("int"))).alias("copy"))
    marked = points.select(*own, "x", "n", "of_class", "copy", F.lit(True).alias("own"))

    def beyond(last: bool) -> DataFrame:
        """The k points of a class nearest to a part from the parts before, or after, it."""
        towards = F.col("x").desc() if last else F.col("x").asc()
        edge = points.select(*own, "x", F.row_number().over(Window.partitionBy(*own).orderBy(towards)).alias("at")).where(F.col("at") <= k)
        ends = edge.groupBy(*own).agg(F.sort_array(F.collect_list("x")).alias("xs"))
        # each part has one point at least, so k parts are enough
        along = Window.partitionBy("g", "c").orderBy("part").rowsBetween(*((-k, -1) if last else (1, k)))
        near = ends.select(*own, F.flatten(F.collect_list("xs").over(along)).alias("near"))
        taken = F.slice("near", F.greatest(F.size("near") - k, F.lit(0)) + 1, k) if last else F.slice("near", 1, k)
        return near.select(*own, F.explode(taken).alias("x")).select(*own, "x", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("of_class"), F.lit(0).alias("copy"), F.lit(False).alias("own"))

    around = Window.partitionBy(*own).orderBy("x")
    x = F.col("x")
    before = [x - F.lag("x", j).over(around) if j else F.lit(0.0) for j in range(k + 1)]
    after = [F.lead("x", j).over(around) - x if j else F.lit(0.0) for j in range(k + 1)]
    every = marked.unionByName(beyond(True)).unionByName(beyond(False)).select("*", *(b.alias(f"b{j}") for j, b in enumerate(before)), *(a.alias(f"a{j}") for j, a in enumerate(after)))
    infinite = F.lit(float("inf"))
    side = lambda name, j: F.coalesce(F.col(f"{name}{j}"), infinite)
    distance = F.lit(None).cast("double")
    for neighbours in range(1, k + 1):
        nearest = [F.greatest(side("b", j), side("a", neighbours - j)) for j in range(neighbours + 1)]
        distance = F.when(F.least(F.lit(k), F.col("of_class") - 1) == neighbours, F.least(*nearest)).otherwise(distance)
    far = every.where("own and copy = 1").select("g", "c", "x", "n", "of_class", distance.alias("r"))

    ship(spark)

    @F.pandas_udf("low double, high double")
    def span(x: pd.Series, r: pd.Series) -> pd.DataFrame:
        """The greatest double too low for each distance, and the greatest within it."""
        a, d = x.to_numpy(dtype=float), r.to_numpy(dtype=float)
        return pd.DataFrame({"low": np.nextafter(-farthest_within(-a, d), -np.inf), "high": farthest_within(a, d)})

    spans = materialise(far.withColumn("s", span("x", "r")).select("g", "c", "x", "n", "of_class", "s.*"), "spans")
    asked = spans.select("g", "c", "x", F.explode(F.array(F.struct(F.col("low").alias("v"), F.lit(-1).alias("sign")), F.struct(F.col("high").alias("v"), F.lit(1).alias("sign")))).alias("q"))
    at = lambda v: F.struct(F.col("g"), v.alias("v"))
    held = kept.select("g", "c", "x", at(F.col("x")).alias("at"), F.col("n").alias("add"), F.lit(0).alias("sign"))
    running = cumulative(held.unionByName(asked.select("g", "c", "x", at(F.col("q.v")).alias("at"), F.lit(0).cast("long").alias("add"), "q.sign")), "at", ["add"])
    within = running.where("sign <> 0").groupBy("g", "c", "x").agg(F.sum(F.col("sign") * F.col("cum_add")).alias("m"))
    weighed = spans.join(within, ["g", "c", "x"])
    mean = lambda e: F.sum(e * F.col("n")) / F.sum("n")
    neighbours = F.least(F.lit(k), F.col("of_class") - 1)
    found = weighed.groupBy("g").agg((digamma(F.sum("n")) + mean(digamma(neighbours)) - mean(digamma(F.col("of_class"))) - mean(digamma(F.col("m")))).alias("i"))
    names = spark.range(1).select(F.posexplode(F.array(*map(F.lit, columns))).alias("at", "name"))
    return names.join(F.broadcast(found), F.col("at") == F.col("g"), "left").select("name", F.greatest(F.coalesce("i", F.lit(0.0)), F.lit(0.0)).alias("information"))
