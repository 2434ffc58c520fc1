"""Second-order gradient boosting: a classifier, a regressor and a pairwise ranker.

Features are cut into bins at exact quantiles. Rows travel as blocks, one table row for up to a few
thousand of them, with the margin that the trees so far give. Each level of a tree is one
aggregate: tasks sum gradients and curvatures by (node, feature, bin) and the best cut of each
node is found from running sums over bins; only a row a node comes to the driver. Leaf values are
-G / (H + l2). For the ranker a group of any size is dealt to blocks by hash, and a block forms all
pairs of its own rows, so a row meets a bounded number of others.

Margins are written anew every few trees, so a lost executor costs a few trees' work on its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise, quoted, ship
from .ranks import quantiles

MODES = ("binary", "regression", "ranking")
#: Rows of a block, about.
BLOCK = 2048
#: Trees between two writings of the margins.
TREES_APART = 8


@dataclass
class Tree:
    """Nodes by number, the root first: ``feature`` -1 marks a leaf; a row goes left if its bin is at most ``cut``."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, value: float, rows: float) -> int:
        for column, x in zip((self.feature, self.cut, self.left, self.right, self.value, self.rows), (-1, 0, -1, -1, value, rows)):
            column.append(x)
        return len(self.feature) - 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins (rows by features) comes to."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        open_ = np.flatnonzero(feature[at] >= 0)
        while len(open_):
            node = at[open_]
            goes = bins[open_, feature[node]] <= cut[node]
            at[open_] = np.where(goes, left[node], right[node])
            open_ = open_[feature[at[open_]] >= 0]
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """``borders`` by feature, ascending; a missing value lies below all of them."""

    mode: str
    features: list[str]
    borders: list[list[float]]
    base: float
    trees: list[Tree]
    losses: list[tuple[float, float | None]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Rows by features of doubles to bins: 0 for NaN, else one more than the borders below."""
        out = np.empty(x.shape, np.uint16)
        for j, borders in enumerate(self.borders):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(borders, x[:, j], "left") + 1)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        return self.base + sum((t.margins(b) for t in self.trees), np.zeros(len(x)))

    def importances(self) -> list[tuple[str, float]]:
        """(feature, share of the rows that its cuts part), the greatest first."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for f, n in zip(t.feature, t.rows):
                if f >= 0:
                    total[f] += n
        total /= total.sum() or 1
        return sorted(zip(self.features, map(float, total)), key=lambda e: (-e[1], e[0]))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def pair_gradients(y: np.ndarray, s: np.ndarray, gains: bool = False) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(gradient, curvature, loss, weight) of one block: over all pairs with y_i > y_j the loss is
    log(1 + exp(s_j - s_i)). With ``gains`` a pair weighs what swapping the two would change in the
    discounted gain, by their places in the block."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    weight_of = np.zeros(len(y))
    if gains:
        place = np.empty(len(y))
        place[np.lexsort((np.arange(len(y)), -s))] = np.arange(len(y))
        weight_of = 1 / np.log2(place + 2)
        best = ((2.0 ** np.sort(y)[::-1] - 1) / np.log2(np.arange(len(y)) + 2)).sum() or 1.0
    loss = total = 0.0
    for i in np.flatnonzero(y > y.min()) if len(y) else ():
        worse = np.flatnonzero(y < y[i])
        d = s[worse] - s[i]
        w = np.abs((2.0 ** y[i] - 2.0 ** y[worse]) * (weight_of[i] - weight_of[worse])) / best if gains else np.ones(len(worse))
        p = _logistic(d)
        g[i] -= (w * p).sum()
        g[worse] += w * p
        c = w * p * (1 - p)
        h[i] += c.sum()
        h[worse] += c
        loss += float((w * np.logaddexp(0, d)).sum())
        total += float(w.sum())
    return g, h, loss, total


def _gradients(mode: str, y: np.ndarray, s: np.ndarray, w: np.ndarray, gains: bool) -> tuple[np.ndarray, np.ndarray, float, float]:
    if mode == "ranking":
        return pair_gradients(y, s, gains)
    if mode == "regression":
        return w * (s - y), w, float((w * (s - y) ** 2).sum()), float(w.sum())
    p = _logistic(s)
    return w * (p - y), w * p * (1 - p), float((w * np.logaddexp(0, np.where(y > 0, -s, s))).sum()), float(w.sum())


def feature_borders(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Distinct exact quantiles of each feature's finite values, at most bins - 1; a feature of
    few values gets the middles between them, so every value has a bin of its own."""
    value = lambda c: quoted(c).cast("double")
    entries = F.array(*(F.struct(F.lit(c).alias("g"), value(c).alias("v")) for c in features))
    long = rows.select(F.explode(entries).alias("e")).select("e.*").where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    counts = materialise(long.groupBy("g", "v").agg(F.count("*").alias("n")), "feature-values")
    few = counts.groupBy("g").agg(F.count("*").alias("d")).where(F.col("d") <= bins)
    listed = {r.g: sorted(r.vs) for r in counts.join(F.broadcast(few), "g", "left_semi").groupBy("g").agg(F.collect_list("v").alias("vs")).collect()}
    rest = [c for c in features if c not in listed]
    cuts: dict[str, list[float]] = {c: [a + (b - a) / 2 for a, b in zip(v, v[1:])] for c, v in listed.items()}
    if rest:
        members = rows.sparkSession.createDataFrame([(c, c) for c in rest], "w string, g string")
        for r in quantiles(counts, members, [i / bins for i in range(1, bins)]).groupBy("w").agg(F.sort_array(F.collect_set("value")).alias("vs")).collect():
            cuts[r.w] = list(r.vs)
    return [cuts.get(c, []) for c in features]


_BLOCKS = "number long, n int, y binary, w binary, held binary, bins binary, margin binary"


def _block_batches(model: Boosted):
    """Rows (number, y, w, held, features...) in the order of their numbers to blocks: one for each
    number, or more where it has over twice as many rows as a block should."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            frame = batch.to_pandas()
            keys.append(frame.iloc[:, 0].to_numpy())
            held.append(frame.iloc[:, 1:].to_numpy(dtype=float))
            size += len(frame)
            if size >= 8 * BLOCK:
                keys, held, size = yield from emit(keys, held, False)
        yield from emit(keys, held, True)

    def emit(keys, held, last):
        key, x = np.concatenate(keys) if keys else np.zeros(0, np.int64), np.concatenate(held) if held else np.zeros((0, 3 + len(model.features)))
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(heads[1:], len(key))
        done, rows = 0, []
        for a, b in zip(heads, ends):
            if b == len(key) and not last and b - a < 4 * BLOCK:
                break  # it may go on in the next batch
            for lo in range(a, b, 2 * BLOCK):
                part = x[lo : min(lo + 2 * BLOCK, b)]
                bins = model.bins(part[:, 3:]).tobytes()
                rows.append((int(key[a]), len(part), part[:, 0].tobytes(), part[:, 1].tobytes(), (part[:, 2] > 0).tobytes(), bins, np.full(len(part), model.base).tobytes()))
            done = b
        yield _as_batch(rows)
        return ([key[done:]], [x[done:]], len(key) - done)

    return blocks


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else ((),) * len(kinds), kinds)], names=names)


def _each_block(batch: pa.RecordBatch, features: int):
    for number, n, y, w, held, bins, margin in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
        yield number, np.frombuffer(y), np.frombuffer(w), np.frombuffer(held, bool), np.frombuffer(bins, np.uint16).reshape(n, features), np.frombuffer(margin)


def _with_margins(trees: list[Tree], features: int):
    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, y, w, held, bins, margin in _each_block(batch, features):
                s = margin + sum((t.margins(bins) for t in trees), np.zeros(len(y)))
                rows.append((number, len(y), y.tobytes(), w.tobytes(), held.tobytes(), bins.tobytes(), s.tobytes()))
            yield _as_batch(rows)

    return moved


@dataclass
class Settings:
    mode: str
    l2: float
    row_share: float
    seed: int
    gains: bool


_SUMS = "node int, feature int, bin int, g double, h double, n double"


def _histogram_batches(settings: Settings, since: list[Tree], growing: Tree, open_: list[int], chosen: list[int], number_of_tree: int, sizes: list[int], with_loss: bool):
    """(node, feature, bin, g, h, n) of the open leaves of the growing tree; with ``with_loss`` also
    the loss of learned (feature -1) and held rows (feature -2), as g over a weight of h. A task
    holds one table of nodes by bins for each feature."""
    place = np.full(len(growing.feature), -1)
    place[open_] = np.arange(len(open_))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {f: np.zeros((len(open_) * sizes[f], 3)) for f in chosen}
        loss = np.zeros((2, 2))
        for batch in batches:
            for number, y, w, held, bins, margin in _each_block(batch, len(sizes)):
                s = margin + sum((t.margins(bins) for t in since), np.zeros(len(y)))
                for side in (0, 1):
                    rows = np.flatnonzero(held == bool(side))
                    if not len(rows):
                        continue
                    g, h, lost, weight = _gradients(settings.mode, y[rows], s[rows], w[rows], settings.gains)
                    loss[side] += (lost, weight)
                    if side:
                        continue
                    if settings.row_share < 1:
                        rng = np.random.default_rng([settings.seed, number_of_tree, number & 0x7FFFFFFFFFFFFFFF, len(y)])
                        mine = rng.random(len(rows)) < settings.row_share
                        rows, g, h = rows[mine], g[mine], h[mine]
                    b = bins[rows]
                    at = place[growing.nodes(b)]
                    inside = at >= 0
                    b, at, values = b[inside], at[inside], np.stack([g[inside], h[inside], np.ones(int(inside.sum()))])
                    for f in chosen:
                        key = at * sizes[f] + b[:, f]
                        for j in range(3):
                            tables[f][:, j] += np.bincount(key, values[j], len(tables[f]))
        parts = []
        for f, table in tables.items():
            k = np.flatnonzero(table[:, 2])
            parts.append((np.array(open_, np.int32)[k // sizes[f]], np.full(len(k), f, np.int32), (k % sizes[f]).astype(np.int32), *table[k].T))
        if with_loss:
            parts.append((np.zeros(2, np.int32), np.array([-1, -2], np.int32), np.zeros(2, np.int32), loss[:, 0], loss[:, 1], np.zeros(2)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["node", "feature", "bin", "g", "h", "n"])

    return sums


def _best_cuts(sums: DataFrame, l2: float, least_rows: int) -> DataFrame:
    """For each node its sums and the cut of greatest gain, if one gains anything: ties go to the
    first feature, then the first bin."""
    total = sums.groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))
    along = Window.partitionBy("node", "feature").orderBy("bin")
    every = Window.partitionBy("node", "feature")
    running = total.select("node", "feature", "bin", *(F.sum(c).over(along).alias(f"l{c}") for c in "ghn"), *(F.sum(c).over(every).alias(c) for c in "ghn"))
    part = lambda g, h: F.try_divide(F.pow(g, F.lit(2)), h + F.lit(l2))
    gain = part(F.col("lg"), F.col("lh")) + part(F.col("g") - F.col("lg"), F.col("h") - F.col("lh")) - part(F.col("g"), F.col("h"))
    enough = (F.col("ln") >= least_rows) & (F.col("n") - F.col("ln") >= least_rows)
    rated = running.select("*", F.when(enough & (gain > 1e-9), F.round(gain, 9)).alias("gain"))
    return rated.groupBy("node").agg(F.max_by(F.struct("feature", "bin", "lg", "lh", "ln", "g", "h", "n", "gain"), F.struct(F.col("gain").isNotNull(), "gain", -F.col("feature"), -F.col("bin"))).alias("cut"))


def boost(
    rows: DataFrame,
    label: str,
    features: list[str],
    mode: str = "binary",
    group: str | None = None,
    key: str | None = None,
    iterations: int = 100,
    depth: int = 4,
    rate: float = 0.1,
    l2: float = 3.0,
    row_share: float = 1.0,
    feature_share: float = 1.0,
    bins: int = 64,
    least_rows: int = 1,
    balanced: bool = False,
    validation: Column | None = None,
    patience: int | None = None,
    gains: bool = False,
    seed: int = 42,
) -> Boosted:
    """Trees over the features for the label.

    ``mode`` is "binary" (a label of 0 and 1, log loss), "regression" (squared loss) or "ranking"
    (pairs of one ``group`` with different labels, dealt to blocks by a hash of ``key``; with
    ``gains`` pairs weigh by discounted gain). ``row_share`` and ``feature_share`` of rows and
    features, drawn anew for each tree, are learned from. ``balanced`` weighs the two classes alike.
    Rows that ``validation`` marks are not learned from: after ``patience`` trees without a lesser
    loss of theirs boosting ends, and the trees up to the least are kept.

    Rows without label are left out. A feature's null and NaN lie below all its values. Without rows
    to learn from, or features, there are no trees.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "ranking" and not (group and key):
        raise ValueError("ranking needs a group and a key")
    spark = rows.sparkSession
    ship(spark)
    y = quoted(label).cast("double")
    held = F.coalesce(validation, F.lit(False)) if validation is not None else F.lit(False)
    value = [F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(features)]
    deal = F.xxhash64(quoted(key) if key else F.monotonically_increasing_id(), F.lit(seed))
    of_group = quoted(group).cast("string") if group else F.lit(None).cast("string")
    known = materialise(rows.where(y.isNotNull() & ~F.isnan(y)).select(of_group.alias("grp"), deal.alias("deal"), y.alias("y"), held.cast("double").alias("held"), *value), "learned")
    learned = known.where("held = 0")
    total = learned.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
    names = [f"x{i}" for i in range(len(features))]
    model = Boosted(mode, list(features), feature_borders(learned, names, bins) if features else [], 0.0, [])
    if not total.n or not features:
        return model
    weight = F.lit(1.0)
    if mode == "binary":
        mean = min(max(total.mean, 1e-6), 1 - 1e-6)
        if balanced:
            weight, mean = F.when(F.col("y") == 1, 0.5 / mean).otherwise(0.5 / (1 - mean)), 0.5
        model.base = math.log(mean / (1 - mean))
    elif mode == "regression":
        model.base = float(total.mean)

    if mode == "ranking":
        parts = known.groupBy("grp", "held").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        placed = known.join(parts.withColumnsRenamed({"grp": "g", "held": "v"}), F.col("grp").eqNullSafe(F.col("g")) & (F.col("held") == F.col("v")))
        number = F.xxhash64("grp", "held", F.pmod(F.col("deal"), F.col("parts")))
    else:
        placed, number = known.withColumn("parts", F.lit(1)), F.pmod(F.col("deal"), F.lit(max(1, -(-(known.count()) // BLOCK))))
    dealt = placed.select(number.alias("number"), "y", weight.alias("w"), "held", *names).repartition("number").sortWithinPartitions("number", "y", *names)
    data = materialise(dealt.mapInArrow(_block_batches(model), _BLOCKS), "blocks")

    settings, sizes = Settings(mode, l2, row_share, seed, gains), [len(b) + 2 for b in model.borders]

    def leaf(g: float, h: float) -> float:
        return -rate * g / (h + l2) if h + l2 else 0.0

    since: list[Tree] = []
    best, best_at = math.inf, 0
    rng = np.random.default_rng(seed)
    for k in range(iterations + (patience is not None)):
        if len(since) == TREES_APART:
            data, since = materialise(data.mapInArrow(_with_margins(since, len(features)), _BLOCKS), "blocks"), []
        chosen = sorted(rng.choice(len(features), max(1, round(feature_share * len(features))), replace=False).tolist())
        tree = Tree()
        open_ = {tree.add(0.0, 0.0)}
        for level in range(depth):
            sums = data.mapInArrow(_histogram_batches(settings, since, tree, sorted(open_), chosen, k, sizes, level == 0), _SUMS)
            if level == 0:
                sums = materialise(sums, "histogram")
                loss = {r.feature: r.g / r.h if r.h else None for r in sums.where("feature < 0").groupBy("feature").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
                model.losses.append((loss.get(-1), loss.get(-2)))
                now = loss.get(-2)
                if now is not None and now < best - 1e-12:
                    best, best_at = now, k
                if patience is not None and now is not None and (k - best_at >= patience or k == iterations):
                    model.trees = model.trees[:best_at]
                    return model
                if k == iterations:
                    return model
                sums = sums.where("feature >= 0")
            found = {r.node: r.cut for r in _best_cuts(sums, l2, least_rows).collect()}
            if level == 0 and 0 in found:
                tree.value[0], tree.rows[0] = leaf(found[0].g, found[0].h), found[0].n
            grown = set()
            for node in sorted(open_):
                cut = found.get(node)
                if cut is None or cut.gain is None:
                    continue
                tree.feature[node], tree.cut[node] = cut.feature, cut.bin
                tree.left[node] = tree.add(leaf(cut.lg, cut.lh), cut.ln)
                tree.right[node] = tree.add(leaf(cut.g - cut.lg, cut.h - cut.lh), cut.n - cut.ln)
                grown |= {tree.left[node], tree.right[node]}
            open_ = grown
            if not open_:
                break
        model.trees.append(tree)
        since.append(tree)
    return model


def boosted_margin(rows: DataFrame, model: Boosted, name: str = "margin") -> DataFrame:
    """rows with the model's margin: log odds, the predicted number, or a score within the group."""
    ship(rows.sparkSession)

    @F.pandas_udf("double")
    def margin(x: pd.Series) -> pd.Series:
        return pd.Series(model.margin(np.array(x.tolist(), dtype=float).reshape(len(x), len(model.features))))

    vector = F.array(*(F.coalesce(quoted(c).cast("double"), F.lit(float("nan"))) for c in model.features)).cast("array<double>")
    return rows.withColumn(name, margin(vector) if model.features else F.lit(model.base))


def boosted_probability(rows: DataFrame, model: Boosted, threshold: float = 0.5) -> DataFrame:
    """rows with probability, predicted (1 from the threshold), model_confidence (0 to 100) and model_threshold."""
    if model.mode != "binary":
        raise ValueError("only a classifier gives probabilities")
    p = 1 / (1 + F.exp(-F.col("probability")))
    found = boosted_margin(rows, model, "probability").withColumn("probability", p)
    return found.withColumns({"predicted": (F.col("probability") >= threshold).cast("int"), "model_confidence": F.col("probability") * 100, "model_threshold": F.lit(float(threshold))})


def boosted_leaves(model: Boosted) -> list[tuple[float, list]]:
    """(value, conditions) of every leaf, as ``shapley`` takes them: a condition is (feature, cut, goes
    left, share of the parent's rows), over bins."""
    out = []

    def walk(t: Tree, node: int, path: list) -> None:
        if t.feature[node] < 0:
            out.append((t.value[node], path))
            return
        for left, child in ((True, t.left[node]), (False, t.right[node])):
            walk(t, child, [*path, (t.feature[node], float(t.cut[node]), left, t.rows[child] / t.rows[node] if t.rows[node] else 0.0)])

    for t in model.trees:
        walk(t, 0, [])
    return out
