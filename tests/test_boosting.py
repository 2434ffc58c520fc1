"""Second-order trees, the pairwise ranker and contributions, against brute force."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.operators import boosting as bo
from signalloom.operators import metrics, model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 900
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n), rng.normal(size=n)], axis=1)
    x[rng.random(n) < 0.1, 3] = np.nan
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * np.sin(2 * x[:, 0]) + (x[:, 1] > 2) * 1.5 - 1)))).astype(float)
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r), float(t), i % 4, i % 5 == 0) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double, g int, held boolean").repartition(5).persist()


NAMES = ["a", "b", "c", "d"]


def arrays(df):
    rows = df.orderBy("id").select(*NAMES, "y").collect()
    x = np.array([[np.nan if v is None else v for v in r[:4]] for r in rows], float)
    return x, np.array([r.y for r in rows])


def brute_tree(bins, g, h, depth, l2, sizes):
    """Paths of the best tree as nested tuples."""
    if depth == 0 or not len(g):
        return -g.sum() / (h.sum() + l2)
    best, score = None, 1e-9
    for f in range(bins.shape[1]):
        for cut in range(sizes[f]):
            left = bins[:, f] <= cut
            if left.all() or not left.any():
                continue
            gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[~left].sum() ** 2 / (h[~left].sum() + l2) - g.sum() ** 2 / (h.sum() + l2)
            if round(gain, 9) > score:
                best, score = (f, cut), round(gain, 9)
    if best is None:
        return -g.sum() / (h.sum() + l2)
    left = bins[:, best[0]] <= best[1]
    return (*best, *(brute_tree(bins[m], g[m], h[m], depth - 1, l2, sizes) for m in (left, ~left)))


def nested(t, node=0):
    return t.value[node] if t.feature[node] < 0 else (t.feature[node], t.cut[node], nested(t, t.left[node]), nested(t, t.right[node]))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3]) if isinstance(a, tuple) else abs(a - b) < 1e-9


@pytest.mark.parametrize("mode", ["binary", "regression"])
def test_trees_against_brute_force(table, mode):
    m = bo.boost(table, "y", NAMES, mode, iterations=2, depth=3, rate=1.0, l2=2.0, bins=16)
    x, y = arrays(table)
    bins, s = m.bins(x), np.full(len(y), m.base)
    for t in m.trees:
        p = 1 / (1 + np.exp(-s))
        g, h = (p - y, p * (1 - p)) if mode == "binary" else (s - y, np.ones(len(y)))
        assert same(nested(t), brute_tree(bins, g, h, 3, 2.0, [len(b) + 2 for b in m.borders]))
        s = s + t.margins(bins)
    assert np.allclose(s, m.margin(x))
    assert sum(t.rows[0] for t in m.trees) == 2 * len(y)


def test_many_trees_and_written_margins(table, monkeypatch):
    one = bo.boost(table, "y", NAMES, iterations=5, depth=2, l2=1.0, bins=8)
    monkeypatch.setattr(bo, "TREES_APART", 2)
    monkeypatch.setattr(bo, "BLOCK", 64)
    other = bo.boost(table, "y", NAMES, iterations=5, depth=2, l2=1.0, bins=8)
    assert all(same(nested(a), nested(b)) for a, b in zip(one.trees, other.trees))


def test_early_stopping_keeps_the_best_round(table):
    m = bo.boost(table, "y", NAMES, iterations=14, depth=3, rate=0.9, l2=0.1, validation=F.col("held"), patience=3, row_share=0.8, feature_share=0.8)
    held = [b for _, b in m.losses]
    assert len(m.trees) == int(np.argmin(held)) < 14
    x, y = arrays(table.where("held"))
    s = m.margin(x)
    assert abs(np.logaddexp(0, np.where(y > 0, -s, s)).mean() - min(held)) < 1e-9


def test_l2_and_balance(table):
    loose, tight = (bo.boost(table, "y", NAMES, iterations=1, depth=2, rate=1.0, l2=l2) for l2 in (0.0, 1e6))
    assert max(map(abs, tight.trees[0].value)) < 1e-3 < max(map(abs, loose.trees[0].value))
    few = table.where("y = 1 and id % 6 = 0").unionByName(table.where("y = 0"))
    plain, even = (bo.boost(few, "y", NAMES, iterations=3, depth=2, balanced=b) for b in (False, True))
    mean = lambda m: bo.boosted_probability(few, m).agg(F.avg("probability")).first()[0]
    assert mean(even) > mean(plain) + 0.15


def test_pair_gradients():
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 3, 25).astype(float), rng.normal(size=25)
    for gains in (False, True):
        place = {i: k for k, i in enumerate(np.lexsort((np.arange(25), -s)))}
        top = sum((2.0**v - 1) / math.log2(k + 2) for k, v in enumerate(sorted(y, reverse=True)))
        g, h, loss, total = np.zeros(25), np.zeros(25), 0.0, 0.0
        for i, j in itertools.product(range(25), repeat=2):
            if y[i] > y[j]:
                w = abs((2 ** y[i] - 2 ** y[j]) * (1 / math.log2(place[i] + 2) - 1 / math.log2(place[j] + 2))) / top if gains else 1.0
                p = 1 / (1 + math.exp(s[i] - s[j]))
                g[i] -= w * p
                g[j] += w * p
                h[i] += w * p * (1 - p)
                h[j] += w * p * (1 - p)
                loss, total = loss + w * math.log1p(math.exp(s[j] - s[i])), total + w
        got = bo.pair_gradients(y, s, gains)
        assert np.allclose(got[0], g) and np.allclose(got[1], h) and abs(got[2] - loss) < 1e-9 and abs(got[3] - total) < 1e-9
    assert bo.pair_gradients(np.ones(4), np.zeros(4))[2:] == (0.0, 0.0)


@pytest.mark.parametrize("gains", [False, True])
def test_ranker_beats_a_linear_one(spark, gains):
    """What ranks high lies in the middle of a feature, where a linear score can't see it."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(1200):
        a, b = rng.uniform(-2, 2), rng.normal()
        rows.append((i, 2000 + i % 4, float(a), float(b), int(abs(a) < 0.5 and rng.random() < 0.9)))
    df = spark.createDataFrame(rows, "doc_id long, pub_year int, a double, b double, target_emergence int")
    learned, rest = df.where("pub_year < 2003"), df.where("pub_year = 2003")
    m = bo.boost(learned, "target_emergence", ["a", "b"], "ranking", "pub_year", "doc_id", iterations=5, depth=3, rate=0.4, gains=gains)
    linear = model.train_ranker(learned, categorical=())
    at = lambda scored: sum(r.target_emergence for r in scored.orderBy(F.desc("s"), "doc_id").limit(40).collect()) / 40
    boosted = at(bo.boosted_margin(rest, m, "s"))
    assert boosted > 0.8 and boosted > at(model.rank_score(rest, linear).withColumnRenamed("rank_score", "s")) + 0.2


def slow_shapley(leaves, x):
    out = np.zeros(x.shape)
    for value, path in leaves:
        meets, shares = {}, {}
        for f, test, left, n in path:
            inside = x[:, f] <= test if isinstance(test, float) else np.isin(x[:, f], list(test))
            meets[f] = meets.get(f, True) & (inside == left)
            shares[f] = shares.get(f, 1.0) * n
        for f in meets:
            rest = [g for g in meets if g != f]
            for k in range(len(rest) + 1):
                for known in itertools.combinations(rest, k):
                    part = np.full(len(x), math.factorial(k) * math.factorial(len(rest) - k) / math.factorial(len(rest) + 1))
                    for g in rest:
                        part = part * (meets[g] if g in known else shares[g])
                    out[:, f] += value * part * (meets[f] - shares[f])
    return out


def random_leaves(rng, depth, features, trees):
    leaves = []

    def grow(path, left):
        if not left:
            leaves.append((float(rng.normal()), path))
            return
        f = int(rng.integers(features))
        test = frozenset(rng.choice(4, 2, replace=False).astype(float).tolist()) if f == 0 else float(rng.normal())
        share = float(rng.choice([0.0, 0.3, rng.random()]))
        grow([*path, (f, test, True, share)], left - 1)
        grow([*path, (f, test, False, 1 - share)], left - 1)

    for _ in range(trees):
        grow([], depth)
    return leaves


def test_contributions_against_all_sets():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 4, 30).astype(float), rng.normal(size=(30, 5))])
    for depth in (0, 1, 2, 4, 6):
        leaves = random_leaves(rng, depth, 6, 2)
        assert np.allclose(model.shapley(leaves, x), slow_shapley(leaves, x), atol=1e-12)


def test_contributions_at_depth_ten():
    rng = np.random.default_rng(6)
    leaves = random_leaves(rng, 10, 24, 60)
    x = rng.normal(size=(6, 24))
    start = time.time()
    phi = model.shapley(leaves, x)
    assert time.time() - start < 60  # a few seconds when nothing else runs
    reached = sum(v * np.prod([[((r[f] <= t) if isinstance(t, float) else r[f] in t) == left for f, t, left, _ in path] for r in x], axis=1) for v, path in leaves)
    base = sum(v * np.prod([n for *_, n in path]) for v, path in leaves)
    assert np.allclose(phi.sum(axis=1) + base, reached)


def test_boosted_contributions_sum_to_the_margin(table):
    m = bo.boost(table, "y", NAMES, iterations=4, depth=4)
    rows = bo.boosted_margin(table, m).select("margin", model.boosted_contributions(m).alias("s")).limit(50).collect()
    base = m.base + sum(v * np.prod([n for *_, n in p]) for v, p in bo.boosted_leaves(m))
    for r in rows:
        assert abs(base + sum(e.shap for e in r.s) - r.margin) < 1e-9
    assert [n for n, _ in m.importances()] == sorted(NAMES, key=lambda n: -dict(m.importances())[n])


def test_nothing_to_learn_from(table):
    assert bo.boost(table.limit(0), "y", NAMES).trees == [] and bo.boost(table, "y", []).trees == []
    m = bo.boost(table.withColumn("same", F.lit(1.0)), "y", ["same"], iterations=2)
    assert m.margin(np.ones((3, 1))).std() == 0
    assert bo.boosted_probability(table.withColumn("same", F.lit(1.0)), m).count() == 900
    with pytest.raises(ValueError):
        bo.boost(table, "y", NAMES, "ranking")
    with pytest.raises(ValueError):
        bo.boost(table, "y", NAMES, "other")


def test_at_least_the_other_classifier(table):
    rows = table.select("id", "held", "a", "b", "c", F.coalesce("d", F.lit(-9.0)).alias("d"), F.col("y").alias("target_emergence"))
    learned, rest = rows.where("not held"), rows.where("held").drop("held")
    m = bo.boost(learned, "target_emergence", NAMES, iterations=10, depth=3, rate=0.2, l2=3.0)
    other = model.train(learned.drop("held", "id"), categorical=(), iterations=10, depth=3, rate=0.2)
    value = lambda d: metrics.average_precision(d.select(F.col("target_emergence").cast("int").alias("y"), F.col("probability").alias("score"))).first()[0]
    assert value(bo.boosted_probability(rest, m)) >= value(model.score(rest, other)) - 0.03
