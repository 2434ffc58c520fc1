"""The classifier: feature matrix, training, scores, and contributions of features to a score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import quoted, ship
from .boosting import Boosted, boosted_leaves
from .history import year_shares
from .metrics import best_threshold
from .sampling import quota_sample, sample_order

#: Columns that are no features: keys, the label, and what later years or the label's own terms tell.
NOT_FEATURES = ("doc_id", "pub_year", "target_emergence", "topic_id", "domain_id", "source_id", "split", "growth", "future")
SHARES = {"topic_historical_share": "topic_historical_volume", "topic_local_share": "topic_local_volume", "historical_author_share": "historical_author_count"}


def model_input(rows: DataFrame, needed: list[str] | None = None) -> DataFrame:
    """rows with shares by year, null maturity as -1 and null text as "missing"; raises if a needed
    column is missing."""
    have = {k: v for k, v in SHARES.items() if v in rows.columns and k not in rows.columns}
    found = year_shares(rows, have) if have else rows
    if "commercial_maturity_index" in found.columns:
        found = found.withColumn("commercial_maturity_index", F.coalesce("commercial_maturity_index", F.lit(-1.0)))
    if "split" not in found.columns:
        found = found.withColumn("split", F.lit("inference"))
    found = found.withColumns({c: F.coalesce(c, F.lit("missing")) for c, t in found.dtypes if t == "string" and c != "doc_id"})
    if missing := [c for c in needed or () if c not in found.columns]:
        raise ValueError(f"features of the model are missing: {', '.join(missing)}")
    return found


def numeric_features(rows: DataFrame) -> list[str]:
    return [c for c, t in rows.dtypes if c not in NOT_FEATURES and t in ("double", "float", "int", "bigint", "tinyint", "smallint")]


def emergence_strength(label: str = "target_emergence", growth: str = "topic_publication_growth") -> Column:
    """What a regression learns: 0, or one and the logarithm of the growth so far."""
    signal = F.greatest(F.coalesce(F.nanvl(F.col(growth).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return F.col(label) * (1 + F.log1p(signal))


def _assembly(rows: DataFrame, label: str, categorical: tuple[str, ...]) -> list:
    text = [c for c in categorical if c in rows.columns]
    numbers = [c for c in numeric_features(rows) if c not in text and c != label]
    stages = [StringIndexer(inputCol=c, outputCol=f"__{c}", handleInvalid="keep") for c in text]
    return [*stages, VectorAssembler(inputCols=numbers + [f"__{c}" for c in text], outputCol="features", handleInvalid="keep")]


def train(rows: DataFrame, label: str = "target_emergence", categorical: tuple[str, ...] = ("source_tier",), iterations: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 42, balanced: bool = False, mode: str = "binary", validation: Column | None = None, tolerance: float = 0.01, feature_share: str = "all") -> PipelineModel:
    """Gradient-boosted trees over the prepared rows: a classifier, or with ``mode`` "regression" a
    regressor of the label as a number (see ``emergence_strength``).

    ``balanced`` weighs the classes alike. ``validation`` marks rows that are not learned from:
    boosting ends when their loss gets no better by ``tolerance``. ``feature_share`` is the share
    of features that each split looks at ("0.8")."""
    if mode not in ("binary", "regression"):
        raise ValueError("mode must be binary or regression")
    stages = _assembly(rows, label, categorical)
    rows = rows.withColumn("__y", F.col(label).cast("double"))
    kind = GBTClassifier if mode == "binary" else GBTRegressor
    boost = kind(labelCol="__y", featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed, maxBins=64, featureSubsetStrategy=feature_share, validationTol=tolerance)
    if validation is not None:
        rows = rows.withColumn("__validation", F.coalesce(validation, F.lit(False)))
        boost = boost.setValidationIndicatorCol("__validation")
    if balanced:
        learned = rows if validation is None else rows.where(~F.col("__validation"))
        mean = learned.agg(F.avg("__y")).first()[0] or 0.5
        rows = rows.withColumn("__w", F.when(F.col("__y") == 1, 0.5 / max(mean, 1e-6)).otherwise(0.5 / max(1 - mean, 1e-6)))
        boost = boost.setWeightCol("__w")
    return Pipeline(stages=[*stages, boost]).fit(rows)


def training_pairs(rows: DataFrame, group: str, key: str, label: str, most: int, seed: int = 42) -> DataFrame:
    """(better, worse): feature vectors of a positive and a negative row of one group, at most
    ``most`` pairs a group. Each class of a group is first cut to ``most`` rows, so a group of any
    size gives a bounded sample; then each row of the larger one meets one of the other."""
    sampled = []
    for side in (1, 0):
        part = rows.where(F.col(label) == side).select(F.col(group).alias("g"), F.col(key).alias("k"), "features")
        quotas = part.select("g").distinct().withColumn("quota", F.lit(most).cast("long"))
        w = Window.partitionBy("g")
        sampled.append(quota_sample(part, "g", "k", quotas, seed).select("g", "features", (F.row_number().over(w.orderBy(sample_order(F.col("k"), seed), "k")) - 1).alias("i"), F.count("*").over(w).alias("n")))
    good, bad = (s.select("g", F.col("features").alias(f), F.col("i").alias(f"i_{f}"), F.col("n").alias(f"n_{f}")) for s, f in zip(sampled, ("better", "worse")))
    sizes = good.groupBy("g").agg(F.max("n_better").alias("p")).join(bad.groupBy("g").agg(F.max("n_worse").alias("q")), "g")
    slots = sizes.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("p", "q") - 1)).alias("s"), "p", "q")
    placed = slots.select("g", (F.col("s") % F.col("p")).alias("i_better"), (F.col("s") % F.col("q")).alias("i_worse"), "s")
    return placed.join(good, ["g", "i_better"]).join(bad, ["g", "i_worse"]).select("g", "s", "better", "worse")


def train_ranker(rows: DataFrame, group: str = "pub_year", key: str = "doc_id", label: str = "target_emergence", categorical: tuple[str, ...] = ("source_tier",), most: int = 10_000, seed: int = 42) -> PipelineModel:
    """A pairwise logistic ranker: the chance that one row of a group ranks above another is the
    logistic of the difference of their scores. Scores are linear in the features (null as 0).
    Groups are years; at most ``most`` pairs of each are learned from. ``rank_score`` applies it."""
    features = Pipeline(stages=_assembly(rows, label, categorical)).fit(rows)
    known = _finite(features.transform(rows))
    pairs = training_pairs(known, group, key, label, most, seed)
    sign = F.when(F.col("s") % 2 == 0, 1.0).otherwise(-1.0)
    difference = F.zip_with(vector_to_array("better"), vector_to_array("worse"), lambda a, b: (a - b) * sign)
    learned = pairs.select(array_to_vector(difference).alias("features"), (F.col("s") % 2 == 0).cast("double").alias("__y"))
    fitted = LogisticRegression(labelCol="__y", featuresCol="features", fitIntercept=False, regParam=1e-3, maxIter=50).fit(learned)
    return PipelineModel(stages=[*features.stages, fitted])


def _finite(rows: DataFrame) -> DataFrame:
    """rows with NaN features as 0."""
    return rows.withColumn("features", array_to_vector(F.transform(vector_to_array("features"), lambda x: F.nanvl(x, F.lit(0.0)))))


def rank_score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """rows with ``rank_score``: of a ranker the score that orders a group, of a regressor its prediction."""
    last = model.stages[-1]
    if not isinstance(last, LogisticRegressionModel):
        return model.transform(rows).withColumn("rank_score", F.col("prediction")).select(*rows.columns, "rank_score")
    weights = F.array(*(F.lit(float(w)) for w in last.coefficients))
    found = _finite(PipelineModel(stages=model.stages[:-1]).transform(rows))
    dot = F.aggregate(F.zip_with(vector_to_array("features"), weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return found.withColumn("rank_score", dot).select(*rows.columns, "rank_score")


def score(rows: DataFrame, model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """rows with probability, predicted (1 from the threshold), model_confidence (0 to 100) and model_threshold."""
    found = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    names = [c for c in rows.columns if c != "probability"]
    return found.select(*names, F.col("p").alias("probability"), (F.col("p") >= threshold).cast("int").alias("predicted"), (F.col("p") * 100).alias("model_confidence"), F.lit(float(threshold)).alias("model_threshold"), "features")


def tune(rows: DataFrame, model: PipelineModel, label: str = "target_emergence") -> float:
    """The threshold of greatest F1 on these rows."""
    return best_threshold(score(rows, model), label, "probability") or 0.5


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    names = model.stages[-2].getInputCols()
    found = model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, found)), key=lambda x: (-x[1], x[0]))


def _leaves(node, path: list, cover: float) -> list[tuple[float, list]]:
    """(value, conditions (feature, threshold or categories, goes left, share of the parent's rows)) of each leaf."""
    if node.subtreeDepth() == 0:
        return [(float(node.prediction()), path)]
    split, out = node.split(), []
    kind = split.getClass().getSimpleName()
    test = float(split.threshold()) if kind == "ContinuousSplit" else frozenset(split.leftCategories())
    for left, child in ((True, node.leftChild()), (False, node.rightChild())):
        n = float(child.impurityStats().count())
        out += _leaves(child, [*path, (int(split.featureIndex()), test, left, n / cover if cover else 0.0)], n)
    return out


def ensemble(model: GBTClassificationModel) -> list[tuple[float, list]]:
    """All leaves of all trees, values weighted."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        root = tree._call_java("rootNode")
        out += [(weight * value, path) for value, path in _leaves(root, [], float(root.impurityStats().count()))]
    return out


class LeafTables:
    """The leaves of an ensemble as arrays, by how many different features their paths test."""

    def __init__(self, leaves: list[tuple[float, list]]) -> None:
        self.tests: dict[tuple, int] = {}
        by_size: dict[int, list] = {}
        for value, path in leaves:
            slots: dict[int, int] = {}
            share: list[float] = []
            steps = []
            for f, test, left, n in path:
                at = slots.setdefault(f, len(slots))
                share[at : at + 1] = [(share[at] if at < len(share) else 1.0) * n]
                steps.append((self.tests.setdefault((f, test), len(self.tests)), left, at))
            if slots:
                by_size.setdefault(len(slots), []).append((value, list(slots), share, steps))
        self.groups = []
        for size, rows in sorted(by_size.items()):
            longest = max(len(r[3]) for r in rows)
            steps = [r[3] + [r[3][-1]] * (longest - len(r[3])) for r in rows]  # a repeated step changes nothing
            self.groups.append((
                np.array([r[0] for r in rows]),
                np.array([r[1] for r in rows]),
                np.array([r[2] for r in rows], float),
                *(np.array([[s[i] for s in path] for path in steps]) for i in range(3)),
                # the weight of a set of known features is an integral over a polynomial of degree size - 1
                *((x + 1) / 2 if i == 0 else x / 2 for i, x in enumerate(np.polynomial.legendre.leggauss((size + 1) // 2))),
            ))

    def met(self, x: np.ndarray) -> np.ndarray:
        """Rows by tests: which are passed to the left."""
        out = np.empty((len(x), len(self.tests)), bool)
        for (f, test), i in self.tests.items():
            out[:, i] = x[:, f] <= test if isinstance(test, float) else np.isin(x[:, f], list(test))
        return out


#: Entries (rows by leaves by features) that contributions are computed for at once.
_ENTRIES = 1 << 22


def shapley(leaves: list[tuple[float, list]] | LeafTables, x: np.ndarray) -> np.ndarray:
    """Contributions (rows by features) to the margin: exact Shapley values of the path-dependent
    game, in which a leaf's share for an absent feature is the share of training rows.

    A feature's weight over all sets of the others is the integral over t from 0 to 1 of the product
    of t o + (1 - t) z, with o for whether the row meets the leaf's tests and z for their shares.
    Gauss' rule with half as many places as features gives it exactly, so the work for a leaf
    grows as the square of its features, not as two to their power.
    """
    tables = leaves if isinstance(leaves, LeafTables) else LeafTables(leaves)
    out = np.zeros(x.shape)
    for value, features, share, test, left, slot, places, weights in tables.groups:
        count, size = features.shape
        for lo in range(0, len(x), max(1, _ENTRIES // (count * size))):
            rows = x[lo : lo + max(1, _ENTRIES // (count * size))]
            met = tables.met(rows)
            own = np.ones((len(rows), count, size), bool)
            for step in range(test.shape[1]):
                own[:, np.arange(count), slot[:, step]] &= met[:, test[:, step]] == left[:, step]
            factor = np.zeros(own.shape)
            for t, w in zip(places, weights):
                part = t * own + (1 - t) * share
                before, after = np.ones(own.shape), np.ones(own.shape)
                np.cumprod(part[..., :-1], axis=-1, out=before[..., 1:])
                after[..., :-1] = np.cumprod(part[..., :0:-1], axis=-1)[..., ::-1]
                factor += w * before * after
            factor *= (own - share) * value[:, None]
            for i, row in enumerate(factor):
                out[lo + i] += np.bincount(features.ravel(), row.ravel(), x.shape[1])
    return out


def contributions(model: PipelineModel, features: Column) -> Column:
    """Each row's list of (feature, value, contribution) from its feature vector."""
    return _listed(LeafTables(ensemble(model.stages[-1])), model.stages[-2].getInputCols(), lambda x: x)(vector_to_array(features))


def _listed(tables: LeafTables, names: list[str], tested):
    """(feature, value, contribution) of vectors, whose tests are over tested(vectors)."""
    ship(SparkSession.active())

    @F.pandas_udf("array<struct<feature: string, value: double, shap: double>>")
    def found(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), len(names))
        return pd.Series([[{"feature": n, "value": float(v), "shap": float(s)} for n, v, s in zip(names, row, phi)] for row, phi in zip(x, shapley(tables, tested(x)))])

    return found


def boosted_contributions(model: Boosted) -> Column:
    """The same for second-order trees, from their feature columns; missing values are NaN."""
    vector = F.array(*(F.coalesce(quoted(c).cast("double"), F.lit(float("nan"))) for c in model.features))
    return _listed(LeafTables(boosted_leaves(model)), model.features, lambda x: model.bins(x).astype(float))(vector)


def shap_report(rows: DataFrame, column: str = "shap_values") -> DataFrame:
    """(feature, mean_abs_shap) over rows."""
    return rows.select(F.explode(column).alias("e")).groupBy("e.feature").agg(F.avg(F.abs("e.shap")).alias("mean_abs_shap"))
