"""Queries over operators that others only reach through larger plans, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, metrics, model, quality, sampling, selection
from ..sources import tables
from .collection import resume, status
from .table_queries import _KEYWORDS, _STOP, _TERMS
from .works_queries import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH w AS (SELECT doc_id, source, cast(2017 + doc_id % 7 AS INTEGER) AS pub_year, {_TERMS.format("coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')", _STOP)} AS t, {_TERMS.format(f"'{_KEYWORDS}'", _STOP)} AS a FROM documents WHERE length(text) > 0),
f AS (SELECT doc_id, pub_year, source FROM w WHERE pub_year IN (2019, 2021, 2023) AND len(list_intersect(t, a)) >= greatest(1, ceil(len(a) * 6 / 10))),
k AS (SELECT *, count(*) OVER (PARTITION BY pub_year) AS total, row_number() OVER (PARTITION BY pub_year ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM f)
SELECT doc_id, pub_year, total, total <= 25 AS exhaustive FROM k WHERE k <= 25
""")
def evidence_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 matching works of each year, and whether these are all."""
    return evidence.per_year(tables.text_works(spark, sf_dir), _KEYWORDS, years=(2019, 2021, 2023), cap=25).select("doc_id", "pub_year", "total", "exhaustive")


_STRATA = """
q AS (SELECT DISTINCT o_orderpriority || '-' || o_orderstatus AS stratum, cast(40 + 5 * length(o_orderpriority) AS BIGINT) AS quota FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'nobody', 7),
d AS (SELECT o_orderkey AS doc_id, o_orderpriority || '-' || o_orderstatus AS stratum FROM orders),
c AS (SELECT * FROM d WHERE doc_id % 17 = 0),
s AS (SELECT q.stratum, quota, count(doc_id) AS collected FROM q LEFT JOIN c ON c.stratum = q.stratum GROUP BY q.stratum, quota)
"""


def _collection(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All works by stratum, the strata with quotas (one has no works), and the works collected so far."""
    orders = tables.table(spark, sf_dir, "orders")
    stratum = F.concat("o_orderpriority", F.lit("-"), "o_orderstatus").alias("stratum")
    strata = orders.where("o_orderkey % 3 = 0").select(stratum, (40 + 5 * F.length("o_orderpriority")).cast("long").alias("quota")).distinct()
    works = orders.select(F.col("o_orderkey").alias("doc_id"), stratum)
    return works, strata.unionByName(spark.range(1).select(F.lit("nobody").alias("stratum"), F.lit(7).cast("long").alias("quota"))), works.where("doc_id % 17 = 0")


@query(f"WITH {_STRATA} SELECT stratum, quota, collected FROM s")
def collection_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stratum with what has been collected of it."""
    _, strata, collected = _collection(spark, sf_dir)
    return status(strata, collected)


@query(f"""
WITH {_STRATA},
l AS (SELECT d.*, quota - collected AS open, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM d JOIN s USING (stratum) WHERE collected < quota AND doc_id % 17 <> 0)
SELECT doc_id, stratum FROM l WHERE k <= open
""")
def collection_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works that fill the quotas of the strata that are still open."""
    return resume(*_collection(spark, sf_dir))


@query("""
WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(concat(label, ':42')), label, vec_id) AS k FROM embeddings)
SELECT label, count(*) AS rows FROM k WHERE k <= 333 GROUP BY label
""")
def subsample_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows in hash order of a key that many share, the first 333: how many of each key."""
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return sampling.seeded_subsample(rows, "label", 333).groupBy("label").agg(F.count("*").alias("rows"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, cast(year(o_orderdate) AS INTEGER) AS pub_year, cast(o_custkey % 7 AS DOUBLE) AS topic_historical_volume, cast(o_custkey % 3 AS DOUBLE) AS topic_local_volume,
  cast(o_orderkey % 5 AS DOUBLE) AS historical_author_count, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS commercial_maturity_index, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS source_tier FROM orders)
SELECT doc_id, round(coalesce(commercial_maturity_index, -1), 4) AS maturity, coalesce(source_tier, 'missing') AS tier, 'inference' AS split,
  round(topic_historical_volume / (count(*) OVER y + 1e-5), 6) AS topic_historical_share, round(topic_local_volume / (count(*) OVER y + 1e-5), 6) AS topic_local_share, round(historical_author_count / (count(*) OVER y + 1e-5), 6) AS historical_author_share
FROM o WINDOW y AS (PARTITION BY pub_year)
""")
def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is given: shares by year, missing numbers and texts filled, and the split."""
    orders = tables.table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.year("o_orderdate").alias("pub_year"),
        (F.col("o_custkey") % 7).cast("double").alias("topic_historical_volume"),
        (F.col("o_custkey") % 3).cast("double").alias("topic_local_volume"),
        (F.col("o_orderkey") % 5).cast("double").alias("historical_author_count"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")).alias("commercial_maturity_index"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("source_tier"),
    )
    shares = ("topic_historical_share", "topic_local_share", "historical_author_share")
    found = model.model_input(rows, list(shares)).select("doc_id", F.col("commercial_maturity_index").alias("maturity"), F.col("source_tier").alias("tier"), "split", *shares)
    return rounded(rounded(found, "maturity", digits=4), *shares)


@query("""
WITH s AS (SELECT vec_id, cast(label = 3 AS INTEGER) AS y, round(1 / (1 + exp(-(embedding[1]::DOUBLE * 3 + (CASE WHEN label = 3 THEN 0.6 ELSE 0 END)))), 3) AS score FROM embeddings),
c AS (SELECT score, sum(count(*) FILTER (y = 1)) OVER (ORDER BY score DESC) AS tp, sum(count(*) FILTER (y = 0)) OVER (ORDER BY score DESC) AS fp, sum(count(*) FILTER (y = 1)) OVER () AS p FROM s GROUP BY score),
t AS (SELECT score AS threshold FROM c ORDER BY 2 * tp / (tp + fp + p) DESC, score DESC LIMIT 1)
SELECT vec_id, score AS probability, cast(score >= threshold AS INTEGER) AS predicted, round(score * 100, 1) AS model_confidence FROM s, t
""")
def thresholded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores cut at the threshold of greatest F1."""
    x = F.col("embedding")[0].cast("double") * 3 + F.when(F.col("label") == 3, 0.6).otherwise(0.0)
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") == 3).cast("int").alias("y"), F.round(1 / (1 + F.exp(-x)), 3).alias("score"))
    at = metrics.best_threshold(rows)
    return rows.select("vec_id", F.col("score").alias("probability"), (F.col("score") >= F.lit(at)).cast("int").alias("predicted"), F.round(F.col("score") * 100, 1).alias("model_confidence"))


_VECTORS = f"{tables.VECTORS_SQL}, good AS (SELECT *, 100.0 - doc_id % 97 AS confidence FROM vectors)"


@query(f"""
WITH RECURSIVE {_VECTORS},
p AS (SELECT doc_id, vector, row_number() OVER (ORDER BY confidence DESC, doc_id) AS k FROM good QUALIFY k <= 240),
r AS (SELECT doc_id, vector, row_number() OVER (ORDER BY k) AS k FROM p WHERE doc_id % 3 <> 0),
s AS (SELECT a.k, any_value(a.doc_id) AS doc_id, list(list_inner_product(a.vector, b.vector) ORDER BY b.k) AS sims FROM r a, r b GROUP BY a.k),
step AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS chosen
  UNION ALL
  SELECT s.k, CASE WHEN len(chosen) < 15 AND coalesce(list_max(list_transform(chosen, lambda c: s.sims[c])), 0) <= 0.3 THEN list_append(chosen, s.k) ELSE chosen END FROM step JOIN s ON s.k = step.k + 1
),
e AS (SELECT unnest(chosen) AS k, unnest(range(1, len(chosen) + 1)) AS rank FROM (SELECT * FROM step ORDER BY k DESC LIMIT 1))
SELECT doc_id, cast(rank AS INTEGER) AS rank FROM e JOIN s USING (k)
""")
def judged_diverse_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 15 mutually dissimilar works that a judge, asked for twenty at a time, lets pass."""
    rows = tables.vectors(spark, sf_dir).select("doc_id", (100.0 - F.col("doc_id") % 97).alias("confidence"), F.concat(F.lit("work "), F.col("doc_id").cast("string")).alias("title"), F.lit("").alias("abstract"), "vector")
    chosen = selection.relevant_diverse_top(rows, lambda query, works: [w["id"] for w in works if w["id"] % 3], "any", threshold=0.3)
    return spark.createDataFrame([(i, k + 1) for k, i in enumerate(chosen)], "doc_id long, rank int")


@query("""
WITH n AS (SELECT 'o_orderstatus' AS name, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'clerk', CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE cast(o_custkey % 5 AS VARCHAR) END, count(*) FROM orders GROUP BY ALL)
SELECT name, value, n, round(n / sum(n) OVER (PARTITION BY name), 6) AS share FROM n
""")
def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select("o_orderstatus", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5).alias("clerk"))
    return rounded(quality.value_counts(rows, "o_orderstatus", "clerk"), "share")
