"""Nearest-neighbour information against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import information as info


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def brute(points, k=3, missing=-999.0):
    """points: (value, class)."""
    points = [(missing if x is None or math.isnan(x) else x, c) for x, c in points if c is not None]
    points = [(x, c) for x, c in points if abs(x) < math.inf]
    sizes = {c: sum(d == c for _, d in points) for _, c in points}
    points = [(x, c) for x, c in points if sizes[c] > 1]
    if not points:
        return 0.0
    total = psi(len(points))
    for i, (x, c) in enumerate(points):
        near = min(k, sizes[c] - 1)
        r = sorted(abs(z - x) for j, (z, d) in enumerate(points) if d == c and j != i)[near - 1]
        m = sum(abs(z - x) < r or z == x for z, _ in points)
        total += (psi(near) - psi(sizes[c]) - psi(m)) / len(points)
    return max(0.0, total)


def test_digamma(spark):
    got = spark.range(1, 400).select("id", info.digamma(F.col("id")).alias("d")).collect()
    assert all(abs(r.d - psi(r.id)) < 1e-12 for r in got)


def test_bounds_are_those_of_subtraction():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=500), [-1e10, 1e10, 0.0, -0.0, 5e-324, 1e300, -1e300, 3.0]])
    z = np.concatenate([rng.normal(size=500), [1e-5, 1e10 + 2, 0.0, 1.0, 1.0, -1e300, 1e300, 3.0]])
    r = np.abs(z - x)
    h = info.farthest_within(x, r)
    assert np.all((h - x < r) | (r == 0)) and np.all(np.nextafter(h, np.inf) - x >= r) and np.all(h[r == 0] == x[r == 0])


@pytest.mark.parametrize("partitions, k", [(1, 3), (7, 3), (16, 2), (5, 5)])
def test_against_all_pairs(spark, partitions, k):
    rng = random.Random(partitions)
    rows = []
    for i in range(160):
        c = rng.choice(["a", "a", "a", "b", "b", None])
        smooth = rng.gauss(0 if c == "a" else 1.5, 1)
        rows.append((smooth, float(rng.randrange(6)), rng.choice([0.1, 0.2, None, float("nan"), smooth]), rng.choice([float("inf"), -1.0, smooth * 1e12]), c))
    rows += [(0.5, 1.0, 2.0, 3.0, "alone"), (0.25, 1.0, 2.0, 3.0, "two"), (7.5, 1.0, 2.0, 3.0, "two")]
    names = ["smooth", "tied", "odd", "wide"]
    df = spark.createDataFrame(rows, "smooth double, tied double, odd double, wide double, y string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.name: r.information for r in info.neighbour_information(df, names, "y", k).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, name in enumerate(names):
        assert abs(got[name] - brute([(r[i], r[4]) for r in rows], k)) < 1e-9, name
    assert got["smooth"] > 0.05


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1.0, "a", "x.y"), (2.0, "b", "z")], "`a.b` double, y string, z string")
    assert [tuple(r) for r in info.neighbour_information(df, ["a.b"], "y").collect()] == [("a.b", 0.0)]
    assert [tuple(r) for r in info.neighbour_information(df.limit(0), ["a.b"], "y").collect()] == [("a.b", 0.0)]
    with pytest.raises(ValueError):
        info.neighbour_information(df, ["a.b"], "y", 0)
