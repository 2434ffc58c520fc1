"""Profiles of a corpus and of its features."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise, quoted
from .ranks import cumulative, quantiles


def validate_corpus(works: DataFrame, last_labelled: int, expected: int | None = None) -> DataFrame:
    """One row: rows, critical nulls, duplicate ids, labels after the last year that can have
    one, and whether all is well."""
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"null_{c}")
    ids = works.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_doc_ids"))
    counts = works.agg(
        F.count("*").alias("rows"), empty("doc_id"), empty("pub_year"), empty("abstract_text"), F.count_if((F.col("pub_year") > last_labelled) & F.col("target_emergence").isNotNull()).alias("invalid_future_targets")
    )
    both = counts.crossJoin(F.broadcast(ids))
    well = (F.col("null_doc_id") + F.col("null_pub_year") + F.col("null_abstract_text") + F.col("duplicate_doc_ids") + F.col("invalid_future_targets")) == 0
    return both.withColumn("passed", well if expected is None else well & (F.col("rows") == expected))


def corpus_counters(works: DataFrame) -> DataFrame:
    """(name, value, n): works by pub_year, domain_id and target_emergence, and engineering works
    by pub_year. One pass: each task counts its rows under every name before the exchange."""
    named = [(c, F.col(c), F.lit(True)) for c in ("pub_year", "domain_id", "target_emergence")] + [("engineering", F.col("pub_year"), F.coalesce(F.col("is_engineering"), F.lit(False)))]
    entries = F.array(*(F.struct(F.lit(k).alias("name"), x.cast("string").alias("value"), keep.alias("keep")) for k, x, keep in named))
    return works.select(F.explode(entries).alias("e")).select("e.*").where("keep").groupBy("name", "value").agg(F.count("*").alias("n"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """(name, value, n, share) for each column's values, in one pass."""
    entries = F.array(*(F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value")) for c in columns))
    counts = rows.select(F.explode(entries).alias("e")).select("e.*").groupBy("name", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "name").select("name", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def null_profile(rows: DataFrame) -> DataFrame:
    """(name, nulls) of every column: one pass, then turned to rows."""
    counts = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns))
    return counts.unpivot([], rows.columns, "name", "nulls")


def describe(rows: DataFrame, *columns: str) -> DataFrame:
    """(name, n, mean, std, min, median, max, skew, outliers): sample deviation and skewness, and
    values beyond one and a half quartile ranges; null and NaN don't count. A column without values
    has n 0. One pass counts each column's values, reduced in the tasks first; all else comes from
    the counts."""
    value = lambda c: F.when(~F.isnan(quoted(c).cast("double")), quoted(c).cast("double"))
    entries = F.array(*(F.struct(F.lit(i).alias("g"), value(c).alias("v")) for i, c in enumerate(columns)))
    each = rows.select(F.explode(entries).alias("e")).select("e.*").where(F.col("v").isNotNull())
    counts = materialise(each.groupBy("g", "v").agg(F.count("*").alias("n")), "value-counts")
    spark = rows.sparkSession
    members = spark.range(len(columns)).select(F.col("id").cast("int").alias("w"), F.col("id").cast("int").alias("g"))
    cut = quantiles(counts, members, [0.25, 0.5, 0.75], True)
    edges = cut.groupBy("w").agg(*(F.max(F.when(F.col("share") == q, F.col("value"))).alias(k) for k, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    means = counts.groupBy("g").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    # one row a column: centres and fences meet the counts
    known = F.broadcast(means.join(edges, F.col("g") == F.col("w")).drop("w"))
    off, reach = F.col("v") - F.col("mean"), 1.5 * (F.col("q3") - F.col("q1"))
    beyond = (F.col("v") < F.col("q1") - reach) | (F.col("v") > F.col("q3") + reach)
    central = [F.sum(F.col("n") * off**k).alias(f"m{k}") for k in (2, 3)]
    found = counts.join(known, "g").groupBy("g").agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), F.min("v").alias("min"), F.first("median").alias("median"), F.max("v").alias("max"), F.sum(F.when(beyond, F.col("n")).otherwise(0)).alias("outliers"), *central)
    n, spread = F.col("n"), F.try_divide(F.col("m3") / F.col("n"), (F.col("m2") / F.col("n")) ** 1.5)
    skew = F.when(n > 2, spread * F.sqrt(n * (n - 1)) / (n - 2))
    shown = found.select("g", "n", "mean", F.when(n > 1, F.sqrt(F.col("m2") / (n - 1))).alias("std"), "min", "median", "max", skew.alias("skew"), "outliers")
    names = spark.range(1).select(F.posexplode(F.array(*map(F.lit, columns))).alias("at", "name"))
    whole = names.join(F.broadcast(shown), F.col("at") == F.col("g"), "left")
    return whole.select("name", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "median", "max", "skew", F.coalesce("outliers", F.lit(0)).alias("outliers"))


def tier_breakdown(rows: DataFrame, group: str, flag: str) -> DataFrame:
    """(group, n, positives, nulls, rate_percent)."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(flag).alias("positives"), F.count_if(F.col(flag).isNull()).alias("nulls"), F.round(100 * F.avg(flag), 2).alias("rate_percent"))


def yearly_stats(rows: DataFrame, column: str, year: str = "pub_year") -> DataFrame:
    """(year, n, mean, std, zeros): the last is the share of zeros."""
    return rows.groupBy(year).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.avg((F.col(column) == 0).cast("double")).alias("zeros"))


def corpus_metrics(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year"))


def ks_statistic(rows: DataFrame, column: str, y: str) -> DataFrame:
    """One row ks: the greatest distance between the classes' distribution functions."""
    counts = rows.where(F.col(column).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    running = cumulative(counts, "x", ["pos", "neg"]).crossJoin(F.broadcast(totals))
    return running.agg(F.max(F.abs(F.try_divide("cum_pos", "p") - F.try_divide("cum_neg", "n"))).alias("ks"))


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with the average rank of the column, ties sharing theirs; nulls rank first, as one."""
    counts = rows.groupBy(F.col(column).alias("__value")).agg(F.count("*").alias("__c"))
    ranked = cumulative(counts, "__value", ["__c"]).select("__value", (F.col("cum___c") - (F.col("__c") - 1) / 2).alias(name))
    return rows.join(ranked, F.col(column).eqNullSafe(F.col("__value"))).drop("__value")


def spearman_pairs(rows: DataFrame, columns: list[str], above: float = 0.7) -> DataFrame:
    """(first, second, rho) of pairs whose rank correlation exceeds ``above``."""
    spark = rows.sparkSession
    vectors = VectorAssembler(inputCols=columns, outputCol="v", handleInvalid="skip").transform(rows.select(*(F.col(c).cast("double") for c in columns))).select("v")
    matrix = Correlation.corr(vectors, "v", "spearman").first()[0].toArray()
    found = [(columns[i], columns[j], float(matrix[i, j])) for i in range(len(columns)) for j in range(i + 1, len(columns)) if abs(matrix[i, j]) > above]
    return spark.createDataFrame(found, "first string, second string, rho double")


def binned_information(rows: DataFrame, column: str, y: str, bins: int = 20) -> DataFrame:
    """One row information: mutual information, in nats, of the column's quantile bins and the
    class. A documented substitute for the nearest-neighbour estimate. A cut is the least value
    that so many twentieths of the rows reach; rows without value or class are left out."""
    known = rows.where(F.col(column).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    counts = known.groupBy(F.col(column).cast("double").alias("x"), F.col(y).alias("c")).agg(F.count("*").alias("n"))
    values = cumulative(counts.groupBy("x").agg(F.sum("n").alias("n")), "x", ["n"])
    total = values.agg(F.max("cum_n").alias("total"))
    least = [F.min(F.when(F.col("cum_n") * bins >= F.col("total") * i, F.col("x"))).alias(f"c{i}") for i in range(1, bins)]
    cuts = values.crossJoin(F.broadcast(total)).agg(*least).select(F.array_distinct(F.array(*(f"c{i}" for i in range(1, bins)))).alias("cuts"))
    cells = counts.crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter("cuts", lambda c: F.col("x") > c)).alias("b"), "c").agg(F.sum("n").alias("n"))
    total, of_b, of_c = (F.sum("n").over(Window.partitionBy(*k)) for k in ((F.lit(1),), ("b",), ("c",)))
    each = cells.select((F.col("n") / total).alias("p"), (of_b / total).alias("pb"), (of_c / total).alias("pc"))
    return each.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pb") * F.col("pc")))).alias("information"))


def feature_check(rows: DataFrame, *columns: str) -> DataFrame:
    """(name, finite, distinct, mean, std, constant); std is the sample's."""
    long = rows.select(F.lit(0).alias("__"), *(F.col(c).cast("double") for c in columns)).unpivot(["__"], list(columns), "name", "x").drop("__")
    finite = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf"))
    by = long.groupBy("name", "x").agg(F.count("*").alias("c"))
    valued = F.when(F.col("x").isNotNull(), F.col("c"))
    means = by.groupBy("name").agg(F.try_divide(F.sum(F.col("x") * F.col("c")), F.sum(valued)).alias("mean"))
    spread = F.sqrt(F.try_divide(F.sum(F.col("c") * (F.col("x") - F.col("mean")) ** 2), F.sum(valued) - 1))
    # one row a column
    return by.join(F.broadcast(means), "name").groupBy("name").agg(F.bool_and(finite).alias("finite"), F.count("x").alias("distinct"), F.first("mean").alias("mean"), spread.alias("std"), (F.count("x") <= 1).alias("constant"))
