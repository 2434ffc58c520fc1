"""Labels that look ahead: emergence within a corpus, and growth of a topic's whole population.

They are two different definitions and keep different names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import as_year
from .history import history_rows, yearly_counts
from .ranks import quantiles

#: Fixed values of the emergence label.
WINDOW, SMOOTHING, QUANTILE, LEAST_FUTURE = 3, 5.0, 0.9, 3
#: Fixed values of the population label.
GROWTH, AUTHOR_GROWTH = 4.0, 2.5


def topic_growth(works: DataFrame, is_history: Column | None = None) -> DataFrame:
    """(topic_id, pub_year, n, future, growth): log2 of the smoothed rates of the three years
    after and before. Works of one topic and year share it."""
    counts = yearly_counts(works, "topic_id", is_history=is_history)
    w = Window.partitionBy("topic_id").orderBy("pub_year")
    past = F.coalesce(F.sum("n").over(w.rangeBetween(-WINDOW, -1)), F.lit(0))
    future = F.coalesce(F.sum("n").over(w.rangeBetween(1, WINDOW)), F.lit(0))
    rate = lambda x: (x + SMOOTHING) / WINDOW
    return counts.select("topic_id", "pub_year", "n", future.alias("future"), F.log2(rate(future) / rate(past)).alias("growth"))


def growth_thresholds(growth: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(pub_year, threshold): the exact quantile of growth over a year's works, from the rows by
    topic with their counts: the works themselves are not sorted."""
    return growth.groupBy("pub_year").agg(F.percentile("growth", F.lit(quantile), F.col("n")).alias("threshold"))


def emergence_label(works: DataFrame) -> DataFrame:
    """works with growth, future and target_emergence: 1 if growth reaches its year's 0.9 quantile
    and three works or more follow. Works without topic or year get 0. Years whose following
    years lie outside the corpus get labels as any other; leave them out of training."""
    works = works.withColumn("pub_year", as_year(F.col("pub_year")))
    growth = topic_growth(works)
    found = growth.join(growth_thresholds(growth), "pub_year").select(
        "topic_id", "pub_year", "growth", "future", ((F.col("growth") >= F.col("threshold")) & (F.col("future") >= LEAST_FUTURE)).cast("int").alias("target_emergence")
    )
    joined = works.join(found, ["topic_id", "pub_year"], "left")
    return joined.select(*works.columns, "growth", F.coalesce("future", F.lit(0)).alias("future"), F.coalesce("target_emergence", F.lit(0)).alias("target_emergence"))


def label_rates(works: DataFrame) -> DataFrame:
    """(pub_year, works, positives, rate), from counts by topic alone."""
    growth = topic_growth(works).join(growth_thresholds(topic_growth(works)), "pub_year")
    positive = F.when((F.col("growth") >= F.col("threshold")) & (F.col("future") >= LEAST_FUTURE), F.col("n")).otherwise(0)
    return growth.groupBy("pub_year").agg(F.sum("n").alias("works"), F.sum(positive).alias("positives")).select("pub_year", "works", "positives", (F.col("positives") / F.col("works")).alias("rate"))


def _ratio_windows(topic: str = "topic_id") -> tuple:
    w = Window.partitionBy(topic).orderBy("pub_year")
    return w.rangeBetween(-2, 0), w.rangeBetween(3, 5)


def population_growth(counts: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """counts (topic_id, pub_year, n) with future_growth_ratio: three to five years on, against
    the year and the two before; the two years between count for neither."""
    before, after = _ratio_windows()
    zero = F.lit(0)
    ratio = (F.coalesce(F.sum("n").over(after), zero) + epsilon) / (F.coalesce(F.sum("n").over(before), zero) + epsilon)
    return counts.withColumn("future_growth_ratio", ratio)


def new_authors(works: DataFrame) -> DataFrame:
    """(topic_id, pub_year, authors): authors by the year of their first work in the topic."""
    each = works.select("topic_id", as_year(F.col("pub_year")).alias("pub_year"), F.explode("authors_ids").alias("author")).dropna()
    return each.groupBy("topic_id", "author").agg(F.min("pub_year").alias("pub_year")).groupBy("topic_id", "pub_year").agg(F.count("*").alias("authors"))


def population_label(works: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """(topic_id, pub_year, future_growth_ratio, new_authors_baseline, new_authors_future,
    population_emergence, target_status) for each topic and year. Authors are only gathered for
    topics that a publication growth of 4 qualifies."""
    grown = population_growth(yearly_counts(works, "topic_id"), epsilon)
    topics = grown.where(F.col("future_growth_ratio") >= GROWTH).select("topic_id").distinct()
    authors = new_authors(works.join(topics, "topic_id", "left_semi"))
    grid = grown.select("topic_id", "pub_year", "future_growth_ratio").join(authors, ["topic_id", "pub_year"], "full")
    before, after = _ratio_windows()
    zero = F.lit(0)
    both = grid.select("*", F.coalesce(F.sum("authors").over(before), zero).alias("b"), F.coalesce(F.sum("authors").over(after), zero).alias("a")).where("future_growth_ratio is not null")
    enough = F.col("future_growth_ratio") >= GROWTH
    return both.select(
        "topic_id",
        "pub_year",
        "future_growth_ratio",
        F.when(enough, F.col("b")).alias("new_authors_baseline"),
        F.when(enough, F.col("a")).alias("new_authors_future"),
        F.when(~enough, 0).when(F.col("b") == 0, None).otherwise((F.try_divide("a", "b") >= AUTHOR_GROWTH).cast("int")).alias("population_emergence"),
        F.when(~enough, "publication_growth_below_threshold").when(F.col("b") == 0, "insufficient_author_baseline").otherwise("complete").alias("target_status"),
    )


def expanding_outliers(rows: DataFrame, value: str, quantile: float = 0.95, name: str = "is_outlier", is_history: Column | None = None) -> DataFrame:
    """rows with ``name``: 1 if the value reaches the quantile of all rows of history of earlier
    years; years without any get 0. The quantiles come from counts of distinct values by year,
    ordered in range partitions; thresholds are joined by year."""
    rows = rows.withColumn("pub_year", as_year(F.col("pub_year")))
    known = F.col("pub_year").isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & history_rows(is_history)
    counts = rows.where(known).groupBy(F.col("pub_year").alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    years = rows.where("pub_year is not null").select(F.col("pub_year").alias("w")).distinct()
    members = years.join(years.select(F.col("w").alias("g")), F.col("g") < F.col("w"))
    found = quantiles(counts, members, [quantile]).select(F.col("w").alias("__year"), F.col("value").alias("__threshold"))
    joined = rows.join(F.broadcast(found), F.col("pub_year") == F.col("__year"), "left")
    return joined.select(*rows.columns, F.coalesce((F.col(value) >= F.col("__threshold")).cast("int"), F.lit(0)).alias(name))
