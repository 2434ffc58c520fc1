"""Metrics of scored rows (y 0 or 1, score). Rows are first counted by distinct score; all sums
that run over scores are over those counts, in range partitions, not in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import cumulative

#: Thresholds of a table at most.
POINTS = 1000


def score_counts(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, pos, neg) by distinct score; rows without either are left out."""
    valid = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    return valid.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def curve(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """(score, pos, neg, tp, fp, p, n): what a threshold at each distinct score takes in."""
    counts = score_counts(rows, y, score)
    running = cumulative(counts.withColumn("down", -F.col("score")), "down", ["pos", "neg"])
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return running.crossJoin(F.broadcast(totals)).select("score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "p", "n")


def roc_auc(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row roc_auc: the chance that a positive scores above a negative, ties for half; null
    with one class only."""
    c = curve(rows, y, score)
    # negatives below, and half of those level, for each positive
    return c.agg(F.try_divide(F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2)), F.max("p") * F.max("n")).alias("roc_auc"))


def average_precision(rows: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One row average_precision: precision at each distinct score by the recall it adds."""
    return curve(rows, y, score).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("p")).alias("average_precision"))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    root = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "precision": zero(F.try_divide(tp, tp + fp)),
        "recall": zero(F.try_divide(tp, tp + fn)),
        "f1": zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        "mcc": zero(F.try_divide(tp * tn - fp * fn, root)),
    }


def threshold_table(rows: DataFrame, y: str = "y", score: str = "score", points: int = POINTS) -> DataFrame:
    """(threshold, precision, recall, f1, mcc) at up to ``points`` evenly placed distinct scores;
    empty with one class only."""
    c = curve(rows, y, score)
    n = c.count()
    table = c.where((F.col("p") > 0) & (F.col("n") > 0))
    if n > points:
        ranked = cumulative(table.withColumn("one", F.lit(1)), "score", ["one"]).withColumn("i", F.col("cum_one") - 1)
        chosen = F.sequence(F.lit(0), F.lit(points - 1))
        # i is one of floor(k (n - 1) / (points - 1))
        k = F.ceil(F.col("i") * (points - 1) / (n - 1)).cast("long")
        table = ranked.where((F.floor(k * (n - 1) / (points - 1)) == F.col("i")) & (k < F.size(chosen)))
    tp, fp = F.col("tp"), F.col("fp")
    rates = _rates(tp, fp, F.col("p") - tp, F.col("n") - fp)
    return table.select(F.col("score").alias("threshold"), *(c.alias(k) for k, c in rates.items()))


def best_threshold(rows: DataFrame, y: str = "y", score: str = "score") -> float | None:
    """The threshold of greatest F1; of equal ones the least."""
    found = threshold_table(rows, y, score).agg(F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold")))).first()
    return found[0]


def confusion(rows: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """One row tn, fp, fn, tp, precision, recall, f1, mcc."""
    hit, pos = F.col(score) >= threshold, F.col(y) == 1
    cells = rows.agg(F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    return cells.select("*", *(c.alias(k) for k, c in _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()))


def precision_at_k(rows: DataFrame, group: str, k: int, tie: str, y: str = "y", score: str = "score") -> DataFrame:
    """(group, k, precision_at_k, recall_at_k, positives_in_top_k, group_positives). Only rows
    that can be among the best k of their group reach its task: ranks within hash parts first. A null
    group is one like any other."""
    parts = F.pmod(F.xxhash64(tie), F.lit(64))
    best = Window.partitionBy(group, "__part").orderBy(F.col(score).desc(), tie)
    some = rows.select(group, y, score, tie, parts.alias("__part")).withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k)
    top = some.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), tie))).where(F.col("__r") <= k)
    inside = top.groupBy(group).agg(F.count("*").alias("k"), F.sum(y).alias("positives_in_top_k"))
    totals = rows.groupBy(F.col(group).alias("__group")).agg(F.sum(y).alias("group_positives"))
    hits = F.col("positives_in_top_k")
    return inside.join(totals, F.col(group).eqNullSafe(F.col("__group"))).select(group, "k", (hits / F.col("k")).alias("precision_at_k"), F.try_divide(hits, "group_positives").alias("recall_at_k"), "positives_in_top_k", "group_positives")


def ranking_groups(rows: DataFrame, group: str, y: str = "y") -> DataFrame:
    """One row: groups, sizes and positives (median, 0.9 quantile, maximum), groups with 0, 1 and 2 or more positives."""
    each = rows.groupBy(group).agg(F.count("*").alias("size"), F.sum(y).alias("positives"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("size", "positives") for n, f in (("median", lambda c: F.percentile(c, F.lit(0.5))), ("p90", lambda c: F.percentile(c, F.lit(0.9))), ("max", F.max))]
    return each.agg(F.count("*").alias("groups"), *stats, F.count_if(F.col("positives") == 0).alias("no_positive"), F.count_if(F.col("positives") == 1).alias("one_positive"), F.count_if(F.col("positives") >= 2).alias("useful"))
