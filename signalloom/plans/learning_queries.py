"""Queries over what is learned or indexed first: information, trees, a ranker, a term index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting, information, model, sampling, selection
from ..sources import providers, scratch, tables, term_index
from .features import build_features
from .table_queries import _KEYWORDS, _REQUEST, _STOP, _TERMS, ORACLE_SQL as TABLE_SQL
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


# --- information ----------------------------------------------------------------------------

#: The digamma function of a whole number.
_PSI = "(ln({0} + 10.0) - 1 / (2 * ({0} + 10.0)) - 1 / (12 * ({0} + 10.0) ** 2) + 1 / (120 * ({0} + 10.0) ** 4) - 1 / (252 * ({0} + 10.0) ** 6) + 1 / (240 * ({0} + 10.0) ** 8) - 1 / (132 * ({0} + 10.0) ** 10) - " + " - ".join(f"1 / ({{0}} + {i}.0)" for i in range(10)) + ")"
_SIDES = [f"greatest(coalesce(x - lag(x, {j}) OVER w, 'inf'::DOUBLE), coalesce(lead(x, {3 - j}) OVER w - x, 'inf'::DOUBLE))" for j in range(4)]


@query(f"""
WITH p AS (
  SELECT 'o_totalprice' AS name, o_orderstatus AS c, o_totalprice AS x FROM orders
  UNION ALL SELECT 'o_custkey', o_orderstatus, o_custkey::DOUBLE FROM orders
  UNION ALL SELECT 'share', o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN -999.0 ELSE o_totalprice / (1 + o_custkey) END FROM orders
),
k AS (SELECT *, count(*) OVER (PARTITION BY name, c) AS of_class FROM p QUALIFY of_class > 3),
r AS (SELECT name, c, x, of_class, least({", ".join(_SIDES)}) AS r FROM k WINDOW w AS (PARTITION BY name, c ORDER BY x)),
d AS (SELECT name, c, x, max(of_class) AS of_class, min(r) AS r, count(*) AS n FROM r GROUP BY name, c, x),
v AS (SELECT name, x, sum(n) AS n FROM d GROUP BY name, x),
m AS (SELECT d.name, d.c, d.x, d.n, d.of_class, sum(v.n) AS m FROM d JOIN v ON d.name = v.name AND (abs(v.x - d.x) < d.r OR v.x = d.x) GROUP BY ALL)
SELECT name, round(greatest(0, {_PSI.format("sum(n)")} + {_PSI.format("3")} - sum(n * {_PSI.format("of_class")}) / sum(n) - sum(n * {_PSI.format("m")}) / sum(n)), 6) AS information FROM m GROUP BY name
""")
def neighbour_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three numbers of an order and its status; one misses a value in places."""
    share = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / (1 + F.col("o_custkey"))).alias("share")
    rows = tables.table(spark, sf_dir, "orders").select("o_totalprice", "o_custkey", share, "o_orderstatus")
    return rounded(information.neighbour_information(rows, ["o_totalprice", "o_custkey", "share"], "o_orderstatus"), "information")


# --- trees ----------------------------------------------------------------------------------


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Features of all works, their numeric names, and the split by years."""
    features = build_features(scratch.materialise(tables.works(spark, sf_dir), "works"))
    rows = scratch.materialise(model.model_input(features).withColumn("split", sampling.temporal_split(F.col("pub_year"), 1995, 1996, 1997)), "features")
    return rows, model.numeric_features(rows)


@query()
def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order trees learned to 1995 and stopped by 1996, with the scores of 1997 and the three greatest contributions."""
    rows, names = _prepared(spark, sf_dir)
    fitted = boosting.boost(rows.where("split in ('train', 'valid')"), "target_emergence", names, iterations=6, depth=3, rate=0.3, l2=15.0, row_share=0.8, feature_share=0.8, validation=F.col("split") == "valid", patience=3, key="doc_id")
    scored = boosting.boosted_probability(rows.where("split = 'test'"), fitted, 0.3)
    shap = F.transform(model.boosted_contributions(fitted), lambda e: F.struct(e["feature"].alias("feature"), e["shap"].alias("value")))
    return scored.select("doc_id", "probability", "predicted", selection.top_factors(shap, 3).alias("factors"))


@query()
def boosted_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boosted ranker's best hundred works of 1996 and of 1997, learned from pairs of works of one year to 1995."""
    rows, names = _prepared(spark, sf_dir)
    fitted = boosting.boost(rows.where("split = 'train'"), "target_emergence", names, "ranking", "pub_year", "doc_id", iterations=4, depth=3, rate=0.3, gains=True)
    scored = boosting.boosted_margin(rows.where("split in ('valid', 'test')"), fitted, "rank_score")
    return selection.top_per_group(scored.select("doc_id", "pub_year", "target_emergence", "rank_score"), "pub_year", F.col("rank_score"), "doc_id", 100)


# --- term index -----------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> term_index.TermIndex:
    return term_index.build(tables.text_works(spark, sf_dir), scratch.scratch_path(spark, "term-index"))


@query(TABLE_SQL["keyword_search"])
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over written postings."""
    return term_index.IndexedSearch(_index(spark, sf_dir)).search(_KEYWORDS, 60, [2018, 2019, 2020], False)


@query(f"WITH q AS (SELECT {_TERMS.format(f"'{_REQUEST}'", _STOP)} AS a), d AS (SELECT doc_id, 2017 + doc_id % 7 AS y, {_TERMS.format("coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')", _STOP)} AS t FROM documents) SELECT doc_id, cast(y AS INTEGER) AS pub_year, len(list_intersect(t, a)) AS hits FROM d, q WHERE len(list_intersect(t, a)) > 0")
def indexed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a request's terms each work has, counted in postings."""
    return _index(spark, sf_dir).hits(_REQUEST).select(F.col("key").alias("doc_id"), F.col("year").alias("pub_year"), "hits")


_SEED_REQUEST = "thing thin"


@query(f"""
WITH w AS (SELECT doc_id, cast(2017 + doc_id % 7 AS INTEGER) AS pub_year, {_TERMS.format("coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')", _STOP)} AS t FROM documents),
asked AS (SELECT * FROM (VALUES (0, '{_SEED_REQUEST}'), (1, 'thing'), (2, 'thing')) v(attempt, q)),
a AS (SELECT attempt, {_TERMS.format("q", _STOP)} AS a FROM asked),
f AS (SELECT w.doc_id, w.pub_year, attempt, row_number() OVER (PARTITION BY attempt, pub_year ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM w, a
  WHERE pub_year IN (2018, 2019) AND len(list_intersect(t, a.a)) >= greatest(1, ceil(len(a.a) * 6 / 10))),
z AS (SELECT doc_id FROM w, a WHERE attempt = 0 AND len(list_intersect(t, a.a)) >= greatest(1, ceil(len(a.a) * 6 / 10))),
s AS (SELECT doc_id, min(attempt) AS attempt FROM f JOIN z USING (doc_id) WHERE k <= 200 GROUP BY doc_id)
SELECT doc_id, cast(attempt AS INTEGER) AS attempt FROM s ORDER BY s.attempt, doc_id LIMIT 100000
""")
def recovered_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works of two years that match a whole request, by the widened search that finds them: no text is read."""
    search = term_index.IndexedSearch(_index(spark, sf_dir))
    return providers.recover_seeds(_SEED_REQUEST, [2018, 2019], search, spark, limit=400, enough=1_000_000, most=100_000)
