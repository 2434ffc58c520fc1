"""References and citations of a work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import as_year, clip, log_ratio

_COUNTS = "array<struct<year: string, cited_by_count: double>>"


def list_length(works: DataFrame, column: str) -> Column:
    """The length of a list or of a JSON text of one; 0 for null, malformed or other JSON."""
    kind = dict(works.dtypes)[column]
    x = F.col(column)
    return F.coalesce(F.size(x) if kind.startswith("array") else F.json_array_length(x), F.lit(0)).cast("int")


def reference_features(works: DataFrame, column: str = "referenced_works_ids") -> DataFrame:
    """works with reference_count and has_reference_list."""
    n = list_length(works, column)
    return works.withColumns({"reference_count": F.greatest(n, F.lit(0)).cast("double"), "has_reference_list": (n > 0).cast("int")})


def _by_year(works: DataFrame, column: str) -> Column:
    """Entries (year, n) of the yearly counts, sorted; of repeated years the last."""
    x = F.col(column)
    if not dict(works.dtypes)[column].startswith("array"):
        x = F.from_json(x, _COUNTS, {"mode": "PERMISSIVE"})
    entry = lambda e, i: F.struct(e["year"].try_cast("int").alias("year"), i.alias("i"), F.coalesce(e["cited_by_count"].cast("double"), F.lit(0.0)).alias("n"))
    return F.array_sort(F.filter(F.transform(F.coalesce(x, F.array().cast(_COUNTS)), entry), lambda e: e["year"].isNotNull()))


def citation_features(works: DataFrame, column: str = "counts_by_year") -> DataFrame:
    """works with citation_velocity (citations up to the work's year) and citation_acceleration
    (the year's against the one before, as a clipped logarithm). Without a year both are 0.

    One pass over each work's sorted entries, no exchange: the sums keep the last entry of a year
    open until the next year begins, so of repeated years only the last counts."""
    works = works.withColumn("pub_year", as_year(F.col("pub_year")))
    year = F.col("pub_year")
    zero = F.lit(0.0)
    start = F.struct(F.lit(None).cast("int").alias("year"), zero.alias("n"), zero.alias("upto"), zero.alias("now"), zero.alias("before"))

    def closed(s: Column, name: str, counts: Column) -> Column:
        return s[name] + F.when(counts, s["n"]).otherwise(zero)

    def sums(s: Column) -> list[Column]:
        return [closed(s, "upto", s["year"] <= year).alias("upto"), closed(s, "now", s["year"] == year).alias("now"), closed(s, "before", s["year"] == year - 1).alias("before")]

    def step(s: Column, e: Column) -> Column:
        same = s["year"] == e["year"]
        return F.struct(e["year"].alias("year"), e["n"].alias("n"), *(F.when(same, s[k]).otherwise(x).alias(k) for k, x in zip(("upto", "now", "before"), sums(s))))

    total = F.aggregate(_by_year(works, column), start, step, lambda s: F.struct(*sums(s)))
    found = works.withColumn("__cited", F.when(year.isNotNull(), total))
    rise = clip(log_ratio(F.col("__cited.now"), F.col("__cited.before")))
    return found.withColumns({"citation_velocity": F.coalesce("__cited.upto", zero), "citation_acceleration": F.coalesce(rise, zero)}).drop("__cited")
