"""Queries over works as counts, histories and labels, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, history, labels, sampling
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


#: Running and framed sums over a topic's years.
_TY = "ty AS (SELECT topic_id, pub_year, count(*) AS n FROM works WHERE topic_id IS NOT NULL AND pub_year IS NOT NULL GROUP BY ALL)"
_AT = "coalesce(sum({v}) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING), 0)"
_PAST = "coalesce(sum({v}) OVER (PARTITION BY {keys} ORDER BY pub_year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


def _lags(value: str) -> str:
    return ", ".join(f"{_AT.format(v=value, k=k)} AS x{k}" for k in (1, 2, 3))


_G1, _G2 = "log2((x1 + 1.0) / (x2 + 1.0))", "log2((x2 + 1.0) / (x3 + 1.0))"
_CLIP = "greatest(-5.0, least(5.0, {0}))"


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY} SELECT * FROM ty")
def topic_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.topic_year_counts(tables.topic_works(spark, sf_dir))


_DYNAMICS = """
h AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS volume,
    {lags}, min(CASE WHEN n > 0 THEN pub_year END) OVER (PARTITION BY topic_id) AS first
  FROM ty
)
SELECT doc_id, pub_year, topic_id, cast(volume AS DOUBLE) AS topic_historical_volume, round({g}, 6) AS topic_publication_growth, round({a}, 6) AS topic_growth_acceleration,
  cast(greatest(0, pub_year - first) AS DOUBLE) AS topic_age_years
FROM works JOIN h USING (topic_id, pub_year)
""".format(lags=_lags("n"), g=_CLIP.format(_G1), a=_CLIP.format(f"{_G1} - {_G2}"))


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY}, {_DYNAMICS}")
def topic_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.topic_dynamics(tables.topic_works(spark, sf_dir)).drop("domain_id", "source_tier")
    return rounded(found, "topic_publication_growth", "topic_growth_acceleration")


_TY_HIST = "ty AS (SELECT topic_id, pub_year, count(*) FILTER (doc_id % 5 <> 0) AS n FROM works WHERE topic_id IS NOT NULL AND pub_year IS NOT NULL GROUP BY ALL)"


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY_HIST}, {_DYNAMICS}")
def split_aware_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History from four fifths of the works; all works get features."""
    found = history.topic_dynamics(tables.topic_works(spark, sf_dir), F.col("doc_id") % 5 != 0).drop("domain_id", "source_tier")
    return rounded(found, "topic_publication_growth", "topic_growth_acceleration")


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY} SELECT doc_id, pub_year, topic_id, cast(v AS DOUBLE) AS topic_local_volume FROM works JOIN (SELECT topic_id, pub_year, {_PAST.format(v='n', keys='topic_id')} AS v FROM ty) USING (topic_id, pub_year)")
def topic_local_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.topic_local_volume(tables.topic_works(spark, sf_dir)).drop("domain_id", "source_tier")


_GROWTH = """
g AS (
  SELECT *, log2(((future + 5.0) / 3) / ((past + 5.0) / 3)) AS growth FROM (
    SELECT *, coalesce(sum(n) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS past,
      coalesce(sum(n) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS future
    FROM ty)
),
q AS (SELECT pub_year, quantile_cont(growth, 0.9) AS threshold FROM works JOIN g USING (topic_id, pub_year) GROUP BY pub_year)
"""


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY}, {_GROWTH} SELECT doc_id, topic_id, pub_year, round(growth, 6) AS growth, cast(future AS BIGINT) AS future, cast(growth >= threshold AND future >= 3 AS INTEGER) AS target_emergence FROM works JOIN g USING (topic_id, pub_year) JOIN q USING (pub_year)")
def emergence_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.emergence_label(tables.topic_works(spark, sf_dir)).drop("domain_id", "source_tier"), "growth")


@query(f"WITH {tables.LINE_WORKS_SQL}, {_TY}, {_GROWTH} SELECT pub_year, count(*) AS works, count(*) FILTER (growth >= threshold AND future >= 3) AS positives, round(count(*) FILTER (growth >= threshold AND future >= 3) / count(*), 6) AS rate FROM works JOIN g USING (topic_id, pub_year) JOIN q USING (pub_year) GROUP BY pub_year")
def label_rate_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.label_rates(tables.line_works(spark, sf_dir)), "rate")


_AUTHORS = "each AS (SELECT DISTINCT topic_id, pub_year, a FROM (SELECT topic_id, pub_year, unnest(authors_ids) AS a FROM works) WHERE topic_id IS NOT NULL AND pub_year IS NOT NULL), ta AS (SELECT topic_id, pub_year, coalesce(k, 0) AS n FROM (SELECT DISTINCT topic_id, pub_year FROM works WHERE topic_id IS NOT NULL AND pub_year IS NOT NULL) LEFT JOIN (SELECT topic_id, pub_year, count(*) AS k FROM each GROUP BY ALL) USING (topic_id, pub_year))"


@query(
    f"WITH {tables.WORKS_SQL}, {_AUTHORS}, h AS (SELECT *, {_lags('n')} FROM ta) "
    f"SELECT doc_id, pub_year, topic_id, round({_CLIP.format(_G1)}, 6) AS author_growth_rate, round({_CLIP.format(f'{_G1} - {_G2}')}, 6) AS author_growth_acceleration, cast(x1 AS DOUBLE) AS historical_author_count FROM works JOIN h USING (topic_id, pub_year)"
)
def author_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select("doc_id", "pub_year", "topic_id", "authors_ids")
    return rounded(history.author_dynamics(works).drop("authors_ids"), "author_growth_rate", "author_growth_acceleration")


#: History is four fifths of the works; all works get features.
def _past_rows() -> Column:
    return F.col("doc_id") % 5 != 0


@query(
    f"WITH {tables.WORKS_SQL}, {_AUTHORS.replace('FROM works) WHERE', 'FROM works WHERE doc_id % 5 <> 0) WHERE')}, h AS (SELECT *, {_lags('n')} FROM ta) "
    f"SELECT doc_id, pub_year, topic_id, round({_CLIP.format(_G1)}, 6) AS author_growth_rate, round({_CLIP.format(f'{_G1} - {_G2}')}, 6) AS author_growth_acceleration, cast(x1 AS DOUBLE) AS historical_author_count FROM works JOIN h USING (topic_id, pub_year)"
)
def split_aware_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select("doc_id", "pub_year", "topic_id", "authors_ids")
    return rounded(history.author_dynamics(works, _past_rows()).drop("authors_ids"), "author_growth_rate", "author_growth_acceleration")


@query(f"WITH {tables.WORKS_SQL}, {_AUTHORS} SELECT topic_id, pub_year, n AS authors FROM ta")
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.author_counts(tables.works(spark, sf_dir).select("doc_id", "pub_year", "topic_id", "authors_ids"))


def _domain_sql(n: str, first: str) -> str:
    return f"""
WITH {tables.TOPIC_WORKS_SQL},
tdy AS (SELECT topic_id, domain_id, pub_year, {n} AS n FROM works WHERE topic_id IS NOT NULL AND domain_id IS NOT NULL AND pub_year IS NOT NULL GROUP BY ALL),
pair AS (SELECT *, {_PAST.format(v='n', keys='topic_id, domain_id')} AS xy, {first} OVER (PARTITION BY topic_id, domain_id) AS first FROM tdy),
tp AS (SELECT topic_id, pub_year, {_PAST.format(v='n', keys='topic_id')} AS x FROM (SELECT topic_id, pub_year, sum(n) AS n FROM tdy GROUP BY ALL)),
dp AS (SELECT domain_id, pub_year, {_PAST.format(v='n', keys='domain_id')} AS y FROM (SELECT domain_id, pub_year, sum(n) AS n FROM tdy GROUP BY ALL)),
al AS (SELECT pub_year, coalesce(sum(n) OVER (ORDER BY pub_year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM (SELECT pub_year, sum(n) AS n FROM tdy GROUP BY ALL))
SELECT doc_id, pub_year, topic_id, domain_id,
  round(CASE WHEN t > 0 AND xy > 0 THEN greatest(0.0, log2((xy / t + 1e-12) / ((x / t) * (y / t) + 1e-12))) ELSE 0.0 END, 6) AS ppmi_domain_score,
  round(1 / ln(xy + 2.0), 6) AS topic_domain_rarity, cast(y AS DOUBLE) AS domain_history_count,
  cast(CASE WHEN xy > 0 THEN greatest(0, pub_year - first) ELSE 0 END AS DOUBLE) AS topic_domain_age_years
FROM works JOIN pair USING (topic_id, domain_id, pub_year) JOIN tp USING (topic_id, pub_year) JOIN dp USING (domain_id, pub_year) JOIN al USING (pub_year)
"""


@query(_domain_sql("count(*)", "min(pub_year)"))
def topic_domain_ppmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.topic_domain(tables.topic_works(spark, sf_dir)).drop("source_tier"), "ppmi_domain_score", "topic_domain_rarity")


@query(_domain_sql("count(*) FILTER (doc_id % 5 <> 0)", "min(CASE WHEN n > 0 THEN pub_year END)"))
def split_aware_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(history.topic_domain(tables.topic_works(spark, sf_dir), _past_rows()).drop("source_tier"), "ppmi_domain_score", "topic_domain_rarity")


def _source_sql(n: str) -> str:
    return f"""
WITH {tables.WORKS_SQL},
ts AS (SELECT topic_id, source_id, pub_year, {n} AS n FROM works WHERE topic_id IS NOT NULL AND source_id IS NOT NULL AND pub_year IS NOT NULL GROUP BY ALL),
p AS (SELECT *, {_PAST.format(v='n', keys='topic_id, source_id')} AS c FROM ts),
f AS (SELECT topic_id, pub_year, count(*) AS k FROM (SELECT topic_id, source_id, min(pub_year) AS pub_year FROM ts WHERE n > 0 GROUP BY ALL) GROUP BY ALL),
s AS (SELECT topic_id, pub_year, {_PAST.format(v='k', keys='topic_id')} AS d FROM (SELECT DISTINCT topic_id, pub_year FROM ts) LEFT JOIN f USING (topic_id, pub_year))
SELECT doc_id, works.topic_id, works.source_id, works.pub_year, cast(coalesce(c, 0) AS DOUBLE) AS source_history_count,
  round(CASE WHEN c IS NULL THEN 0.0 ELSE 1 / ln(c + 2.0) END, 6) AS source_novelty, cast(CASE WHEN c IS NULL THEN 0 ELSE d END AS DOUBLE) AS topic_source_diversity
FROM works LEFT JOIN p ON works.topic_id = p.topic_id AND works.source_id = p.source_id AND works.pub_year = p.pub_year
LEFT JOIN s ON works.topic_id = s.topic_id AND works.pub_year = s.pub_year
"""


@query(_source_sql("count(*)"))
def source_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select("doc_id", "topic_id", "source_id", "pub_year")
    return rounded(history.source_history(works), "source_novelty")


@query(_source_sql("count(*) FILTER (doc_id % 5 <> 0)"))
def split_aware_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select("doc_id", "topic_id", "source_id", "pub_year")
    return rounded(history.source_history(works, _past_rows()), "source_novelty")


@query(f"WITH {tables.WORKS_SQL} SELECT doc_id, cast(len(referenced_works_ids) AS DOUBLE) AS reference_count, cast(len(referenced_works_ids) > 0 AS INTEGER) AS has_reference_list FROM works")
def reference_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.reference_features(tables.works(spark, sf_dir).select("doc_id", "referenced_works_ids")).drop("referenced_works_ids")


@query(f"""
WITH {tables.TOPIC_WORKS_SQL},
c AS (SELECT l_orderkey AS doc_id, year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT doc_id, coalesce(sum(n) FILTER (y <= pub_year), 0) AS v, coalesce(sum(n) FILTER (y = pub_year), 0) AS a, coalesce(sum(n) FILTER (y = pub_year - 1), 0) AS b FROM works LEFT JOIN c USING (doc_id) GROUP BY doc_id)
SELECT doc_id, cast(v AS DOUBLE) AS citation_velocity, round({_CLIP.format('log2((a + 1.0) / (b + 1.0))')}, 6) AS citation_acceleration FROM s
""")
def citation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select("doc_id", "pub_year", "counts_by_year")
    return rounded(citations.citation_features(works).select("doc_id", "citation_velocity", "citation_acceleration"), "citation_acceleration")


_RATIO = "(coalesce(sum({v}) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 3 FOLLOWING AND 5 FOLLOWING), 0) + 1e-8) / (coalesce(sum({v}) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 0) + 1e-8)"


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY} SELECT topic_id, pub_year, n, round({_RATIO.format(v='n')}, 6) AS future_growth_ratio FROM ty")
def population_growth_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(labels.population_growth(history.topic_year_counts(tables.topic_works(spark, sf_dir))), "future_growth_ratio")


#: Topics that only some orders fall in, so that growth by four occurs.
_RARE = "rare AS (SELECT * REPLACE (topic_id * 100 + CASE WHEN pub_year >= 1998 AND doc_id % 7 = 0 THEN 1 WHEN pub_year < 1998 AND doc_id % 61 = 0 THEN 1 ELSE 2 END AS topic_id) FROM works)"


@query(f"""
WITH {tables.WORKS_SQL}, {_RARE}, ty AS (SELECT topic_id, pub_year, count(*) AS n FROM rare WHERE topic_id IS NOT NULL AND pub_year IS NOT NULL GROUP BY ALL),
gr AS (SELECT topic_id, pub_year, {_RATIO.format(v='n')} AS r FROM ty),
fa AS (SELECT topic_id, y AS pub_year, count(*) AS k FROM (SELECT topic_id, a, min(pub_year) AS y FROM (SELECT topic_id, pub_year, unnest(authors_ids) AS a FROM rare) WHERE topic_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
w AS (
  SELECT coalesce(gr.topic_id, fa.topic_id) AS topic_id, coalesce(gr.pub_year, fa.pub_year) AS pub_year, r, coalesce(k, 0) AS k
  FROM gr FULL JOIN fa ON gr.topic_id = fa.topic_id AND gr.pub_year = fa.pub_year
),
z AS (SELECT topic_id, pub_year, r, coalesce(sum(k) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 0) AS b, coalesce(sum(k) OVER (PARTITION BY topic_id ORDER BY pub_year RANGE BETWEEN 3 FOLLOWING AND 5 FOLLOWING), 0) AS a FROM w)
SELECT topic_id, pub_year, round(r, 6) AS future_growth_ratio, cast(CASE WHEN r >= 4 THEN b END AS BIGINT) AS new_authors_baseline, cast(CASE WHEN r >= 4 THEN a END AS BIGINT) AS new_authors_future,
  CASE WHEN r < 4 THEN 0 WHEN b = 0 THEN NULL ELSE cast(a / b >= 2.5 AS INTEGER) END AS population_emergence,
  CASE WHEN r < 4 THEN 'publication_growth_below_threshold' WHEN b = 0 THEN 'insufficient_author_baseline' ELSE 'complete' END AS target_status
FROM z WHERE r IS NOT NULL
""")
def population_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.works(spark, sf_dir).select("doc_id", "topic_id", "pub_year", "authors_ids")
    kind = F.when((F.col("pub_year") >= 1998) & (F.col("doc_id") % 7 == 0), 1).when((F.col("pub_year") < 1998) & (F.col("doc_id") % 61 == 0), 1).otherwise(2)
    return rounded(labels.population_label(works.withColumn("topic_id", F.col("topic_id") * 100 + kind)), "future_growth_ratio")


@query(f"WITH {tables.WORKS_SQL} SELECT topic_id, y AS pub_year, count(*) AS authors FROM (SELECT topic_id, a, min(pub_year) AS y FROM (SELECT topic_id, pub_year, unnest(authors_ids) AS a FROM works) GROUP BY ALL) GROUP BY ALL")
def new_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.new_authors(tables.works(spark, sf_dir).select("topic_id", "pub_year", "authors_ids"))


@query("""
WITH r AS (SELECT o_orderkey AS doc_id, cast(year(o_orderdate) AS INTEGER) AS pub_year, o_totalprice AS value FROM orders),
t AS (SELECT y, quantile_cont(value, 0.95) AS q FROM r JOIN (SELECT DISTINCT pub_year AS y FROM r) ON pub_year < y GROUP BY y)
SELECT doc_id, pub_year, value, coalesce(cast(value >= q AS INTEGER), 0) AS is_outlier FROM r LEFT JOIN t ON pub_year = y
""")
def expanding_quantile_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("pub_year"), F.col("o_totalprice").alias("value"))
    return labels.expanding_outliers(rows, "value")


@query(f"WITH {tables.TOPIC_WORKS_SQL}, {_TY}, v AS (SELECT topic_id, pub_year, {_PAST.format(v='n', keys='topic_id')} AS x FROM ty), k AS (SELECT pub_year, count(doc_id) AS t FROM works GROUP BY ALL) SELECT doc_id, round(x / (t + 1e-5), 8) AS topic_local_share FROM works JOIN v USING (topic_id, pub_year) JOIN k USING (pub_year)")
def year_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.topic_local_volume(tables.topic_works(spark, sf_dir))
    return rounded(history.year_shares(rows, {"topic_local_share": "topic_local_volume"}).select("doc_id", "topic_local_share"), "topic_local_share", digits=8)


@query("""
WITH w AS (SELECT c_mktsegment AS key, count(*) AS weight FROM customer GROUP BY ALL),
e AS (SELECT *, 1000 * weight / (SELECT sum(weight) FROM w) AS x FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY x - floor(x) DESC, key) AS k FROM e)
SELECT key, weight, cast(floor(x) + CASE WHEN k <= 1000 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r
""")
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tables.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("key")).agg(F.count("*").alias("weight"))
    return sampling.allocate(weights, 1000)


@query("""
WITH q AS (SELECT n_nationkey AS stratum, 5 + n_nationkey % 4 AS quota FROM nation),
r AS (SELECT c_custkey, c_nationkey AS stratum, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat(c_custkey, ':42')), c_custkey) AS k FROM customer)
SELECT c_custkey, stratum FROM r JOIN q USING (stratum) WHERE k <= quota
""")
def stratified_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("stratum"))
    quotas = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("stratum"), (5 + F.col("n_nationkey") % 4).alias("quota"))
    return sampling.quota_sample(rows, "stratum", "c_custkey", quotas).select("c_custkey", "stratum")


@query(f"WITH {tables.TOPIC_WORKS_SQL} SELECT CASE WHEN pub_year <= 1997 THEN 'train' WHEN pub_year <= 1998 THEN 'valid' WHEN pub_year <= 1999 THEN 'test' ELSE 'unused' END AS split, pub_year, count(*) AS n FROM works GROUP BY ALL")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.topic_works(spark, sf_dir)
    return works.groupBy(sampling.temporal_split(F.col("pub_year"), 1997, 1998, 1999).alias("split"), "pub_year").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, CASE WHEN k <= round(0.7 * n) THEN 'train' WHEN k <= round(0.85 * n) THEN 'valid' ELSE 'test' END AS split FROM r
""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return sampling.exact_stratified_split(rows, "toxic", "doc_id", {"train": 0.7, "valid": 0.15, "test": 0.15})
