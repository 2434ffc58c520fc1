"""Features of a work from what was published before its year.

All of them are counts per key and year, framed by RANGE windows over the year and joined back
to the works by that key: a window never runs over works, so its partitions hold one row per
year. ``is_history`` restricts what counts as history (a training set, say), while every work
still gets its features. Works without the keys keep the defaults. ``onto`` gets the columns
in place of works: a chain of features then counts the works each time, not the chain so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import as_year, clip, log_ratio, share


def history_rows(is_history: Column | None) -> Column:
    """The condition for a row to count as history; all rows by default."""
    return F.lit(True) if is_history is None else is_history


def _years(works: DataFrame) -> DataFrame:
    return works.withColumn("pub_year", as_year(F.col("pub_year")))


def yearly_counts(works: DataFrame, *keys: str, is_history: Column | None = None) -> DataFrame:
    """(keys, pub_year, n): works of history in each year; years with other works only have 0."""
    valid = F.col("pub_year").isNotNull()
    for k in keys:
        valid &= F.col(k).isNotNull()
    return _years(works).where(valid).groupBy(*keys, "pub_year").agg(F.count_if(history_rows(is_history)).alias("n"))


def topic_year_counts(works: DataFrame) -> DataFrame:
    return yearly_counts(works, "topic_id")


def _at(key: str, offset: int, value: str = "n") -> Column:
    """The count so many years before."""
    w = Window.partitionBy(key).orderBy("pub_year").rangeBetween(-offset, -offset)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _before(value: str, *keys: str) -> Column:
    """The sum over all earlier years."""
    w = Window.partitionBy(*keys).orderBy("pub_year").rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _first(value: Column, *keys: str) -> Column:
    return F.min(value).over(Window.partitionBy(*keys))


def _back(works: DataFrame, found: DataFrame, keys: list[str], columns: dict[str, float]) -> DataFrame:
    """works with the columns found by key, or their defaults."""
    joined = works.join(found.select(*keys, *columns), keys, "left")
    return joined.select(*(F.col(c) for c in works.columns), *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in columns.items()))


def topic_dynamics(works: DataFrame, is_history: Column | None = None, onto: DataFrame | None = None) -> DataFrame:
    """topic_historical_volume (three years), topic_publication_growth, topic_growth_acceleration,
    topic_age_years since the topic's first year, its own included."""
    works = _years(works)
    counts = yearly_counts(works, "topic_id", is_history=is_history)
    three = Window.partitionBy("topic_id").orderBy("pub_year").rangeBetween(-3, -1)
    c1, c2, c3 = (_at("topic_id", k) for k in (1, 2, 3))
    first = _first(F.when(F.col("n") > 0, F.col("pub_year")), "topic_id")
    found = counts.select(
        "topic_id",
        "pub_year",
        F.coalesce(F.sum("n").over(three), F.lit(0)).cast("double").alias("topic_historical_volume"),
        clip(log_ratio(c1, c2)).alias("topic_publication_growth"),
        clip(log_ratio(c1, c2) - log_ratio(c2, c3)).alias("topic_growth_acceleration"),
        F.greatest(F.lit(0), F.col("pub_year") - first).cast("double").alias("topic_age_years"),
    )
    names = ("topic_historical_volume", "topic_publication_growth", "topic_growth_acceleration", "topic_age_years")
    return _back(works if onto is None else onto, found, ["topic_id", "pub_year"], dict.fromkeys(names, 0.0))


def author_counts(works: DataFrame, is_history: Column | None = None) -> DataFrame:
    """(topic_id, pub_year, authors): distinct authors of history, 0 where a topic's works of a year have none."""
    grid = yearly_counts(works, "topic_id").select("topic_id", "pub_year")
    each = _years(works).where(history_rows(is_history)).select("topic_id", "pub_year", F.explode("authors_ids").alias("author"))
    known = each.dropna().distinct().groupBy("topic_id", "pub_year").agg(F.count("*").alias("authors"))
    return grid.join(known, ["topic_id", "pub_year"], "left").select("topic_id", "pub_year", F.coalesce("authors", F.lit(0)).alias("authors"))


def author_dynamics(works: DataFrame, is_history: Column | None = None, onto: DataFrame | None = None) -> DataFrame:
    """author_growth_rate, author_growth_acceleration, historical_author_count (the year before)."""
    works = _years(works)
    a1, a2, a3 = (_at("topic_id", k, "authors") for k in (1, 2, 3))
    found = author_counts(works, is_history).select(
        "topic_id",
        "pub_year",
        clip(log_ratio(a1, a2)).alias("author_growth_rate"),
        clip(log_ratio(a1, a2) - log_ratio(a2, a3)).alias("author_growth_acceleration"),
        a1.cast("double").alias("historical_author_count"),
    )
    return _back(works if onto is None else onto, found, ["topic_id", "pub_year"], {"author_growth_rate": 0.0, "author_growth_acceleration": 0.0, "historical_author_count": 0.0})


def topic_domain(works: DataFrame, is_history: Column | None = None, onto: DataFrame | None = None) -> DataFrame:
    """ppmi_domain_score, topic_domain_rarity, domain_history_count, topic_domain_age_years."""
    works = _years(works)
    pairs = yearly_counts(works, "topic_id", "domain_id", is_history=is_history)

    def past(*keys: str) -> DataFrame:
        return pairs.groupBy(*keys, "pub_year").agg(F.sum("n").alias("n")).select(*keys, "pub_year", _before("n", *keys).alias("_".join([*keys, "past"])))

    # one row per year: the running total needs no key
    years = pairs.groupBy("pub_year").agg(F.sum("n").alias("n"))
    total = years.select("pub_year", F.coalesce(F.sum("n").over(Window.orderBy("pub_year").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("total"))
    both = pairs.select("topic_id", "domain_id", "pub_year", _before("n", "topic_id", "domain_id").alias("pair"), _first(F.when(F.col("n") > 0, F.col("pub_year")), "topic_id", "domain_id").alias("first"))
    both = both.join(past("topic_id"), ["topic_id", "pub_year"]).join(past("domain_id"), ["domain_id", "pub_year"]).join(total, "pub_year")
    x, y, xy = F.col("topic_id_past") / F.col("total"), F.col("domain_id_past") / F.col("total"), F.col("pair") / F.col("total")
    found = both.select(
        "topic_id",
        "domain_id",
        "pub_year",
        F.when((F.col("total") > 0) & (F.col("pair") > 0), F.greatest(F.lit(0.0), F.log2((xy + 1e-12) / (x * y + 1e-12)))).otherwise(0.0).alias("ppmi_domain_score"),
        (1 / F.log1p(F.col("pair") + 1.0)).alias("topic_domain_rarity"),
        F.col("domain_id_past").cast("double").alias("domain_history_count"),
        F.when(F.col("pair") > 0, F.greatest(F.lit(0), F.col("pub_year") - F.col("first"))).otherwise(0).cast("double").alias("topic_domain_age_years"),
    )
    names = ("ppmi_domain_score", "topic_domain_rarity", "domain_history_count", "topic_domain_age_years")
    return _back(works if onto is None else onto, found, ["topic_id", "domain_id", "pub_year"], dict.fromkeys(names, 0.0))


def source_history(works: DataFrame, is_history: Column | None = None, onto: DataFrame | None = None) -> DataFrame:
    """source_history_count, source_novelty, topic_source_diversity (distinct earlier sources,
    counted by the year in which each first appears)."""
    works = _years(works)
    counts = yearly_counts(works, "topic_id", "source_id", is_history=is_history)
    past = counts.select("topic_id", "source_id", "pub_year", _before("n", "topic_id", "source_id").alias("past"))
    grid = counts.select("topic_id", "pub_year").distinct()
    firsts = counts.where("n > 0").groupBy("topic_id", "source_id").agg(F.min("pub_year").alias("pub_year")).groupBy("topic_id", "pub_year").agg(F.count("*").alias("fresh"))
    seen = grid.join(firsts, ["topic_id", "pub_year"], "left").select("topic_id", "pub_year", _before("fresh", "topic_id").alias("sources"))
    found = past.join(seen, ["topic_id", "pub_year"]).select(
        "topic_id", "source_id", "pub_year", F.col("past").cast("double").alias("source_history_count"), (1 / F.log1p(F.col("past") + 1.0)).alias("source_novelty"), F.col("sources").cast("double").alias("topic_source_diversity")
    )
    return _back(works if onto is None else onto, found, ["topic_id", "source_id", "pub_year"], {"source_history_count": 0.0, "source_novelty": 0.0, "topic_source_diversity": 0.0})


def topic_local_volume(works: DataFrame, is_history: Column | None = None, onto: DataFrame | None = None) -> DataFrame:
    """topic_local_volume: works of the topic in all earlier years."""
    works = _years(works)
    found = yearly_counts(works, "topic_id", is_history=is_history).select("topic_id", "pub_year", _before("n", "topic_id").cast("double").alias("topic_local_volume"))
    return _back(works if onto is None else onto, found, ["topic_id", "pub_year"], {"topic_local_volume": 0.0})


def year_shares(works: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each of columns (new name -> column) over the number of works of its year. The count is an
    aggregate that is joined back: a window by year would hold a year in one task."""
    totals = works.groupBy("pub_year").agg(F.count("doc_id").alias("__total"))
    joined = works.join(F.broadcast(totals), "pub_year", "left")
    return joined.select(*works.columns, *(share(F.col(c), F.col("__total")).alias(name) for name, c in columns.items()))
