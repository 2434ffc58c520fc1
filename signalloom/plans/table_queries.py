"""Queries for profiles, metrics, selection, texts and vectors, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, records, texts
from ..operators import evidence, metrics, model, quality, sampling, selection, text_geometry
from ..sources import providers, scratch, tables
from . import works_queries
from .features import build_features
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


# --- profiles -------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT doc_id % 950 AS doc_id, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE 2017 + doc_id % 7 END AS pub_year, CASE WHEN doc_id % 89 = 0 THEN '' ELSE text END AS abstract_text, toxic AS target_emergence FROM documents LEFT JOIN labels USING (doc_id))
SELECT *, null_doc_id + null_pub_year + null_abstract_text + duplicate_doc_ids + invalid_future_targets = 0 AS passed FROM (
  SELECT count(*) AS rows, count(*) FILTER (doc_id IS NULL) AS null_doc_id, count(*) FILTER (pub_year IS NULL) AS null_pub_year,
    count(*) FILTER (abstract_text IS NULL OR abstract_text = '') AS null_abstract_text, count(*) FILTER (pub_year > 2020 AND target_emergence IS NOT NULL) AS invalid_future_targets,
    count(*) - count(DISTINCT doc_id) AS duplicate_doc_ids FROM r)
""")
def validate_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = docs.select(
        (F.col("doc_id") % 950).alias("doc_id"),
        F.when(F.col("doc_id") % 97 != 0, 2017 + F.col("doc_id") % 7).alias("pub_year"),
        F.when(F.col("doc_id") % 89 == 0, "").otherwise(F.col("text")).alias("abstract_text"),
        F.col("toxic").alias("target_emergence"),
    )
    return quality.validate_corpus(rows, 2020)


@query("""
SELECT name, nulls FROM (SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (lang IS NULL) AS lang, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic
  FROM (SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))) UNPIVOT (nulls FOR name IN (doc_id, lang, quality, toxic))
""")
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.null_profile(rows.select("doc_id", "lang", "quality", "toxic"))


@query("""
WITH r AS (SELECT doc_id, 2017 + doc_id % 7 AS pub_year, lang AS domain_id, doc_id % 3 = 0 AS is_engineering, toxic AS target_emergence FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'pub_year' AS name, pub_year::VARCHAR AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'domain_id', domain_id, count(*) FROM r GROUP BY ALL
UNION ALL SELECT 'target_emergence', target_emergence::VARCHAR, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'engineering', pub_year::VARCHAR, count(*) FROM r WHERE is_engineering GROUP BY ALL
""")
def corpus_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.corpus_counters(docs.select("doc_id", (2017 + F.col("doc_id") % 7).alias("pub_year"), F.col("lang").alias("domain_id"), (F.col("doc_id") % 3 == 0).alias("is_engineering"), F.col("toxic").alias("target_emergence")))


@query("SELECT name, value, n, round(n / (SELECT count(*) FROM documents), 6) AS share FROM (SELECT 'lang' AS name, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL)")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.value_counts(tables.table(spark, sf_dir, "documents"), "lang", "source"), "share")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS x FROM lineitem" for c in _NUMBERS)


@query(f"""
WITH l AS ({_LONG}),
s AS (SELECT name, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, quantile_cont(x, 0.5) AS median, max(x) AS max, skewness(x) AS skew, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM l GROUP BY name)
SELECT s.name, n, round(mean, 4) AS mean, round(std, 4) AS std, min, round(median, 4) AS median, max, round(skew, 4) AS skew, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM s JOIN l ON s.name = l.name GROUP BY ALL
""")
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.describe(tables.table(spark, sf_dir, "lineitem"), *_NUMBERS), "mean", "std", "median", "skew", digits=4)


@query("SELECT source, count(*) AS n, sum(toxic)::BIGINT AS positives, count(*) FILTER (toxic IS NULL) AS nulls, round(100 * avg(toxic), 2) AS rate_percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def tier_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.tier_breakdown(rows, "source", "toxic")


@query("SELECT cast(year(l_shipdate) AS INTEGER) AS pub_year, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(stddev_samp(l_discount), 6) AS std, round(avg((l_discount = 0)::DOUBLE), 6) AS zeros FROM lineitem GROUP BY ALL")
def yearly_feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("pub_year"), "l_discount")
    return rounded(quality.yearly_stats(rows, "l_discount"), "mean", "std", "zeros")


@query("SELECT count(*) AS rows, cast(min(year(o_orderdate)) AS INTEGER) AS first_year, cast(max(year(o_orderdate)) AS INTEGER) AS last_year FROM orders")
def corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.corpus_metrics(tables.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("pub_year")))


@query(f"SELECT name, true AS finite, count(DISTINCT x) AS distinct, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, count(DISTINCT x) <= 1 AS constant FROM ({_LONG}) GROUP BY name")
def feature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.feature_check(tables.table(spark, sf_dir, "lineitem"), *_NUMBERS), "mean", "std", digits=4)


@query("""
WITH c AS (SELECT l_extendedprice AS x, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY ALL)
SELECT round(max(abs(a / tp - b / tn)), 6) AS ks FROM (SELECT sum(p) OVER (ORDER BY x) AS a, sum(n) OVER (ORDER BY x) AS b, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM c)
""")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(quality.ks_statistic(rows, "l_extendedprice", "y"), "ks")


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(f"WITH r AS (SELECT {_RANK.format('l_quantity')} AS a, {_RANK.format('l_extendedprice')} AS b, {_RANK.format('l_discount')} AS c FROM lineitem), m AS (SELECT corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM r) SELECT * FROM (SELECT 'l_quantity' AS first, 'l_extendedprice' AS second, round(ab, 6) AS rho FROM m UNION ALL SELECT 'l_quantity', 'l_discount', round(ac, 6) FROM m UNION ALL SELECT 'l_extendedprice', 'l_discount', round(bc, 6) FROM m) WHERE abs(rho) > 0.0")
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.spearman_pairs(tables.table(spark, sf_dir, "lineitem"), list(_NUMBERS), 0.0), "rho")


@query("""
WITH r AS (SELECT l_quantity AS x, cast(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem),
k AS (SELECT x, sum(count(*)) OVER (ORDER BY x) AS upto, sum(count(*)) OVER () AS total FROM r GROUP BY x),
cuts AS (SELECT DISTINCT min(x) FILTER (upto * 20 >= total * i) AS c FROM k, range(1, 20) AS t(i) GROUP BY i),
b AS (SELECT y, (SELECT count(*) FROM cuts WHERE x > c) AS b FROM r),
n AS (SELECT b, y, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS pc FROM n)
SELECT round(sum(p * ln(p / (pb * pc))), 6) AS information FROM p
""")
def binned_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(quality.binned_information(rows, "l_quantity", "y"), "information")


# --- metrics --------------------------------------------------------------------------------

#: Scored rows: positives score higher on the whole, with many ties.
_SCORED = "s AS (SELECT l_orderkey, l_suppkey, l_partkey, year(l_shipdate) AS g, cast(l_returnflag = 'R' AS INTEGER) AS y, cast((l_partkey * 7 + l_suppkey * 13) % 100 + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END AS DOUBLE) AS score FROM lineitem)"
_CURVE = f"{_SCORED}, c AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY score), k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem")
    base = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 100
    return lines.select("l_orderkey", "l_suppkey", "l_partkey", F.year("l_shipdate").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (base + F.when(F.col("l_returnflag") == "R", 20).otherwise(0)).cast("double").alias("score"))


@query(f"WITH {_CURVE} SELECT round(sum(pos * (n - fp + neg / 2)) / (max(p) * max(n)), 6) AS roc_auc FROM k")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_auc(_scored(spark, sf_dir)), "roc_auc")


@query(f"WITH {_CURVE} SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM k")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.average_precision(_scored(spark, sf_dir)), "average_precision")


@query(f"""
WITH {_CURVE}, t AS (SELECT score, tp::DOUBLE AS tp, fp::DOUBLE AS fp, (p - tp)::DOUBLE AS fn, (n - fp)::DOUBLE AS tn FROM k)
SELECT score AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0), 6) AS mcc FROM t
""")
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_table(_scored(spark, sf_dir)), "precision", "recall", "f1", "mcc")


@query(f"""
WITH {_SCORED}, c AS (SELECT count(*) FILTER (score < 60 AND y = 0) AS tn, count(*) FILTER (score >= 60 AND y = 0) AS fp, count(*) FILTER (score < 60 AND y = 1) AS fn, count(*) FILTER (score >= 60 AND y = 1) AS tp FROM s)
SELECT tn, fp, fn, tp, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) AS mcc FROM c
""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.confusion(_scored(spark, sf_dir), 60.0), "precision", "recall", "f1", "mcc")


_DOCS = "s AS (SELECT doc_id, doc_id % 7 AS g, toxic AS y, round((doc_id * 37 % 101) / 101.0 + toxic * 0.3, 3) AS score FROM labels)"


def _scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "labels")
    return rows.select("doc_id", (F.col("doc_id") % 7).alias("g"), F.col("toxic").alias("y"), F.round((F.col("doc_id") * 37 % 101) / 101.0 + F.col("toxic") * 0.3, 3).alias("score"))


@query(f"""
WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, doc_id) AS k FROM s)
SELECT g, count(*) FILTER (k <= 20) AS k, round(sum(y) FILTER (k <= 20) / count(*) FILTER (k <= 20), 6) AS precision_at_k, round(sum(y) FILTER (k <= 20) / nullif(sum(y), 0), 6) AS recall_at_k,
  (sum(y) FILTER (k <= 20))::BIGINT AS positives_in_top_k, sum(y)::BIGINT AS group_positives FROM r GROUP BY g
""")
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.precision_at_k(_scored_docs(spark, sf_dir), "g", 20, "doc_id"), "precision_at_k", "recall_at_k")


@query(f"""
WITH {_DOCS}, e AS (SELECT g, count(*) AS size, sum(y)::BIGINT AS positives FROM s GROUP BY g)
SELECT count(*) AS groups, quantile_cont(size, 0.5)::DOUBLE AS size_median, quantile_cont(size, 0.9)::DOUBLE AS size_p90, max(size) AS size_max, quantile_cont(positives, 0.5)::DOUBLE AS positives_median,
  quantile_cont(positives, 0.9)::DOUBLE AS positives_p90, max(positives) AS positives_max, count(*) FILTER (positives = 0) AS no_positive, count(*) FILTER (positives = 1) AS one_positive, count(*) FILTER (positives >= 2) AS useful FROM e
""")
def ranking_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_groups(_scored_docs(spark, sf_dir), "g")


# --- selection ------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT user_id, event_id, event_type, value FROM events)
SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM r GROUP BY user_id
""")
def dedup_first_pos_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return selection.first_position_last_value(rows, "user_id", "event_id")


@query("SELECT c_custkey, o_totalprice, o_orderdate FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, arg_min(o_orderdate, o_orderkey) AS o_orderdate FROM orders GROUP BY ALL) ON c_custkey = o_custkey")
def keep_first_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate")
    return selection.keep_first_join(tables.table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_orderkey")


#: Titles made of a table's words, so that some are reviews.
_TITLES = "t AS (SELECT p_partkey AS doc_id, CASE p_partkey % 9 WHEN 0 THEN 'A survey of ' || p_name WHEN 1 THEN 'Recent advances in ' || p_name WHEN 2 THEN 'Обзор: ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 11 = 0 THEN 'Here, we critically review ' || p_type WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS abstract, CASE WHEN p_size = 1 THEN 'Review' ELSE 'article' END AS work_type FROM part)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kind = key % 9
    return tables.table(spark, sf_dir, "part").select(
        key.alias("doc_id"),
        F.when(kind == 0, F.concat(F.lit("A survey of "), "p_name")).when(kind == 1, F.concat(F.lit("Recent advances in "), "p_name")).when(kind == 2, F.concat(F.lit("Обзор: "), "p_name")).otherwise(F.col("p_name")).alias("title"),
        F.when(key % 11 == 0, F.concat(F.lit("Here, we critically review "), "p_type")).when(key % 13 == 0, None).otherwise(F.col("p_type")).alias("abstract"),
        F.when(F.col("p_size") == 1, "Review").otherwise("article").alias("work_type"),
    )


_IS_REVIEW = "(lower(work_type) = 'review' OR coalesce(regexp_matches(title, '(?i)\\b(survey|review|recent (advances|progress|developments))\\b|обзор'), false) OR coalesce(regexp_matches(abstract, '(?i)here,?\\s+we (critically )?review\\b'), false))"


@query(f"WITH {_TITLES} SELECT doc_id, {_IS_REVIEW} AS is_review FROM t")
def review_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("doc_id", predicates.is_review(F.col("title"), F.col("work_type"), F.col("abstract")).alias("is_review"))


@query(f"WITH {_TITLES} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM t WHERE {_IS_REVIEW})")
def left_anti_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = _titles(spark, sf_dir).where(predicates.is_review(F.col("title"), F.col("work_type"), F.col("abstract")))
    return tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(reviews.select(F.col("doc_id").alias("l_partkey")), "l_partkey", "left_anti")


@query("""
WITH o AS (SELECT l_orderkey AS doc_id, list(DISTINCT p_type ORDER BY p_type) AS topics FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
e AS (SELECT doc_id, unnest(topics) AS name FROM o)
SELECT name, arg_min('T' || doc_id || name, doc_id) AS id, count(*) AS frequency FROM e GROUP BY name
""")
def topic_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    works = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_set("p_type")).alias("names"))
    topics = F.transform("names", lambda n: F.struct(F.concat(F.lit("T"), F.col("doc_id").cast("string"), n).alias("id"), n.alias("display_name")))
    return selection.discover_topics(works.select("doc_id", topics.alias("topics")))


@query("SELECT p_brand AS name, count(*) AS frequency, round(avg(p_size) / 50, 6) AS similarity FROM part GROUP BY p_brand HAVING (avg(p_size) / 50 >= 0.5 AND count(*) / (SELECT count(*) FROM part) >= 0.01) OR (avg(p_size) / 50 >= 0.65 AND count(*) >= 2) OR (avg(p_size) / 50 >= 0.3 AND count(*) / (SELECT count(*) FROM part) >= 0.05)")
def topic_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part")
    total = parts.agg(F.count("*").alias("seeds"))
    topics = parts.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("frequency"), (F.avg("p_size") / 50).alias("similarity")).crossJoin(F.broadcast(total))
    return rounded(topics.where(predicates.selects_topic(F.col("similarity"), F.col("frequency"), F.col("seeds"))).drop("seeds"), "similarity")


_TERMS = """
list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]*'), lambda w: lower(w)), lambda w: NOT list_contains([{1}], w)),
  lambda w: CASE WHEN length(w) > 4 AND suffix(w, 'ies') THEN left(w, length(w) - 3) || 'y' WHEN length(w) > 4 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, length(w) - 1) ELSE w END))
""".strip()
_STOP = ", ".join(f"'{w}'" for w in texts.QUERY_STOPWORDS)
_REQUEST = "the onsen entions and therings of attion"


@query(f"WITH q AS (SELECT {_TERMS.format(f"'{_REQUEST}'", _STOP)} AS a), d AS (SELECT doc_id, {_TERMS.format('text', _STOP)} AS t FROM documents) SELECT doc_id, len(list_intersect(t, a)) >= greatest(1, ceil(len(a) * 6 / 10)) AS matches, len(list_intersect(t, a)) AS hits FROM d, q")
def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.lit(_REQUEST)
    found = tables.table(spark, sf_dir, "documents").select("doc_id", predicates.term_hits(F.col("text"), asked).cast("long").alias("hits"))
    return found.select("doc_id", predicates.enough_terms(F.col("hits"), asked).alias("matches"), "hits")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT (SELECT greatest(1, cast(floor(count(*) * 0.85) AS BIGINT)) FROM orders)")
def keep_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.keep_top_share(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT min(o_totalprice) FROM orders WHERE o_orderkey % 1000 = 7)")
def relevance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.relevance_floor(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", F.col("o_orderkey") % 1000 == 7)


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice, cast(rank AS INTEGER) AS rank FROM r WHERE rank <= 3
""")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return selection.top_per_group(rows, "o_custkey", F.col("o_totalprice"), "o_orderkey", 3)


# --- texts ----------------------------------------------------------------------------------


@query("SELECT doc_id, text AS lenient, CASE WHEN doc_id % 3 <> 1 THEN text END AS strict FROM documents")
def abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted indexes of whole texts, some with a gap, and the texts rebuilt from them."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("t"), F.when(F.col("doc_id") % 3 == 1, 2).otherwise(0).alias("gap"))
    indexed = docs.select("doc_id", texts.inverted_index(F.col("t"), F.col("gap")).alias("index"))
    return indexed.select("doc_id", texts.lenient_abstract(F.col("index")).alias("lenient"), texts.strict_abstract(F.col("index")).alias("strict"))


@query("""
WITH a AS (SELECT l_orderkey AS doc_id, s_name AS name, l_linenumber AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey % 2 = 0),
f AS (SELECT doc_id, name, min(k * 1000000 + regexp_extract(name, '[0-9]+')::BIGINT) AS o FROM a GROUP BY ALL)
SELECT o.o_orderkey AS doc_id, array_to_string(coalesce(list(name ORDER BY o) FILTER (name IS NOT NULL), [])[1:4], ';') AS companies FROM orders o LEFT JOIN f ON o.o_orderkey = f.doc_id GROUP BY ALL
""")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    kind = F.when(F.col("s_nationkey") % 2 == 0, "company").otherwise("education")
    order = F.col("l_linenumber") * 1_000_000 + F.regexp_extract("s_name", "[0-9]+", 0).cast("long")
    entry = F.struct(order.alias("o"), F.struct(F.array(F.struct(F.col("s_name").alias("display_name"), kind.alias("type"))).alias("institutions")).alias("a"))
    lists = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["a"])).alias("json"))
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey").join(lists, "o_orderkey", "left")
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.array_join(records.company_names(F.coalesce("json", F.lit("[]"))), ";").alias("companies"))


@query("SELECT page_id, CASE WHEN url = '' THEN NULL ELSE string_split(url, '/')[-1] END AS short, regexp_matches(url, '^https?://') AS web, length(url) <= 200 AND NOT regexp_matches(url, '[\\x00-\\x1F\\x7F]') AS valid FROM pages")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return tables.table(spark, sf_dir, "pages").select("page_id", texts.short_id(url).alias("short"), (records.article_link(url, F.lit(None), F.lit("x")) == url).alias("web"), predicates.valid_query(url).alias("valid"))


@query("""
WITH t AS (SELECT p_partkey AS doc_id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' sodium-ion cell' WHEN 1 THEN ' Na-ion' WHEN 2 THEN ' quantum sensor' ELSE '' END AS title,
  CASE WHEN p_partkey % 3 = 0 THEN 'Sodium anodes with sodium salts' ELSE 'sodium once' END AS abstract FROM part)
SELECT doc_id, (len(regexp_extract_all(title, '(?i)\\bsodium\\b')) + len(regexp_extract_all(title, '\\bNa-ion\\b')) > 0) OR len(regexp_extract_all(abstract, '(?i)\\bsodium\\b')) >= 2 AS ion, regexp_matches(title, '(?i)\\bquantum\\b') AS quantum FROM t
""")
def topical_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    tail = F.when(key % 4 == 0, " sodium-ion cell").when(key % 4 == 1, " Na-ion").when(key % 4 == 2, " quantum sensor").otherwise("")
    rows = tables.table(spark, sf_dir, "part").select(key.alias("doc_id"), F.concat("p_name", tail).alias("title"), F.when(key % 3 == 0, "Sodium anodes with sodium salts").otherwise("sodium once").alias("abstract"))
    return rows.select("doc_id", predicates.matches_ion(F.col("title"), F.col("abstract"), "sodium-ion batteries").alias("ion"), predicates.matches_quantum_sensing(F.col("title"), F.col("abstract"), "quantum sensors").alias("quantum"))


_NUMS = "list_distinct(regexp_extract_all(replace({0}, ',', '.'), '[0-9]+(?:\\.[0-9]+)?'))"


@query(f"WITH r AS (SELECT d.doc_id, d.text, coalesce(o.text, '') AS result FROM documents d LEFT JOIN documents o ON o.doc_id = d.doc_id - d.doc_id % 2) SELECT doc_id, length(trim(text)) >= 200 AND regexp_matches(text, '(?i)\\b(demonstrat|show|observ|achiev|measur|result|reduc|improv)') AND len(list_filter({_NUMS.format('result')}, lambda x: NOT list_contains({_NUMS.format('text')}, x))) = 0 AS grounded FROM r")
def numeric_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as results: even documents against themselves, odd ones' texts against the one before."""
    docs = tables.table(spark, sf_dir, "documents")
    results = docs.select(F.col("doc_id").alias("other"), F.col("text").alias("result"))
    both = docs.join(results, F.col("other") == F.col("doc_id") - F.col("doc_id") % 2, "left")
    return both.select("doc_id", predicates.grounded_numbers(F.col("result"), F.col("text")).alias("grounded"))


_GENERAL = ", ".join(f"'{w}'" for w in texts.GENERIC_TERMS)
_EVIDENCE = "list_transform(list_filter(regexp_extract_all({0}, '[A-Za-z][A-Za-z0-9]+'), lambda w: (length(w) > 2 OR upper(w) IN ('AI', 'VR', 'ML')) AND lower(w) NOT IN (" + _GENERAL + ")), lambda w: lower(w))"


#: The order of a list's first occurrences; list_distinct keeps none.
_IN_ORDER = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(rf"""
WITH w AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents),
e AS (SELECT doc_id, coalesce({_EVIDENCE.format('title')}, []) AS every, coalesce({_EVIDENCE.format(r"regexp_extract(title, '(?i)\b(?:with emphasis on|for|towards?|in)\s+(.+)$', 1)")}, []) AS focus FROM w),
t AS (SELECT doc_id, {_IN_ORDER.format('every')} AS terms, focus FROM e),
p AS (SELECT doc_id, terms, list_filter(terms, lambda x: list_contains(focus, x)) AS inside, list_filter(terms, lambda x: NOT list_contains(focus, x)) AS outside FROM t)
SELECT doc_id, array_to_string(CASE WHEN len(inside) > 0 THEN list_concat(inside[1:2], outside[1:1]) ELSE terms[1:3] END, ' ') AS phrase FROM p
""")
def search_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.text_works(spark, sf_dir).select("doc_id", texts.search_phrase(F.col("title")).alias("phrase"))


def _stem_sql(w: str) -> str:
    low = f"lower({w})"
    bare = f"left({low}, length({w}) - 3)"
    return f"CASE WHEN length({w}) > 6 AND suffix({low}, 'ing') THEN CASE WHEN right({bare}, 1) = left(right({bare}, 2), 1) THEN left({bare}, length({w}) - 4) ELSE {bare} END WHEN length({w}) > 4 AND suffix({low}, 's') THEN left({low}, length({w}) - 1) ELSE {low} END"


_WEIGHT_SQL = "CASE lower(w) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in texts.COMMON_WEIGHTS.items()) + " ELSE least(2.3, 1 + 0.15 * greatest(length(w) - 5, 0)) END"
_TITLE_STOP = ", ".join(f"'{w}'" for w in texts.TITLE_STOPWORDS)
_NO_ACRONYM = ", ".join(f"'{w}'" for w in texts.NO_ACRONYMS)


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS title, coalesce(text, '') AS abstract FROM documents),
p AS (SELECT doc_id, unnest(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]*[^A-Za-z]*')) AS x, generate_subscripts(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]*[^A-Za-z]*'), 1) - 1 AS i FROM d),
h AS (SELECT doc_id, {_stem_sql("v")} AS stem, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(abstract, '[A-Za-z][A-Za-z0-9]*')) AS v FROM d) GROUP BY ALL),
q AS (SELECT doc_id, x, i, regexp_extract(x, '^[A-Za-z][A-Za-z0-9]*') AS w, count(*) OVER (PARTITION BY doc_id) AS words FROM p),
w AS (SELECT q.*, substr(x, length(w) + 1) AS rest, {_WEIGHT_SQL} AS weight, lower(w) NOT IN ({_TITLE_STOP}) AS plain, coalesce(h.n, 0) AS support FROM q LEFT JOIN h ON h.doc_id = q.doc_id AND h.stem = {_stem_sql("w")}),
c AS (SELECT a.doc_id, a.i, a.w AS first, b.w AS second, a.weight + b.weight AS weight, least(a.support, b.support, {texts.MOST_SUPPORT}) * (a.weight + b.weight) + a.i / greatest(a.words, 1) AS score
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE a.plain AND b.plain AND NOT regexp_matches(a.rest, '[.:;!?]') AND least(a.support, b.support) > 0),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i DESC, first DESC, second DESC) = 1),
acronym AS (SELECT doc_id, arg_min(w.w, w.i) AS w FROM w JOIN best b USING (doc_id) WHERE w.i < b.i AND lower(w.w) NOT IN ({_NO_ACRONYM}) AND length(w.w) <= {texts.ACRONYM_LETTERS} AND length(regexp_replace(w.w, '[^A-Z]', '', 'g')) >= 2 AND w.support > 0 GROUP BY doc_id),
tail AS (SELECT doc_id, regexp_extract(string_agg(CASE WHEN w.i = b.i + 1 THEN w.rest ELSE w.x END, '' ORDER BY w.i), '(?i)(?:^|[^\pL\pN_])(?:in|for|on|with|towards?)\s+([A-Za-z][A-Za-z0-9]*)(?:$|[^\pL\pN_])', 1) AS term FROM w JOIN best b USING (doc_id) WHERE w.i > b.i GROUP BY doc_id),
use AS (SELECT doc_id, any_value(term) AS w FROM tail JOIN w USING (doc_id) WHERE w.w = term AND w.plain AND w.support > 0 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(acronym.w, use.w) IS NOT NULL THEN '"' || first || ' ' || second || '" AND ' || coalesce(acronym.w, use.w) WHEN best.weight >= {texts.LEAST_WEIGHT} THEN '"' || first || ' ' || second || '"' END AS thematic
FROM d LEFT JOIN best ON best.doc_id = d.doc_id LEFT JOIN acronym ON acronym.doc_id = d.doc_id LEFT JOIN use ON use.doc_id = d.doc_id
""")
def thematic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.with_thematic_query(tables.text_works(spark, sf_dir), "title", "abstract_text").select("doc_id", "thematic")


@query("""
WITH w AS (SELECT doc_id, cast(2017 + doc_id % 7 AS INTEGER) AS pub_year FROM documents), y AS (SELECT unnest([2023, 2022, 2021, 2030])::INTEGER AS year)
SELECT year, count(doc_id) AS count, count(doc_id) <= 1000 AS exhaustive FROM y LEFT JOIN w ON year = pub_year GROUP BY year
""")
def evidence_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.yearly_counts(tables.text_works(spark, sf_dir), (2023, 2022, 2021, 2030))


_KEYWORDS = "that was"


@query(f"""
WITH w AS (SELECT doc_id, cast(2017 + doc_id % 7 AS INTEGER) AS pub_year, {_TERMS.format("coalesce(string_split(text, chr(10))[1], '') || ' ' || coalesce(text, '')", _STOP)} AS t, {_TERMS.format(f"'{_KEYWORDS}'", _STOP)} AS a FROM documents),
r AS (SELECT doc_id, pub_year, row_number() OVER (PARTITION BY pub_year ORDER BY md5(concat(doc_id, ':42')), doc_id) AS k FROM w WHERE pub_year IN (2018, 2019, 2020) AND len(list_intersect(t, a)) >= greatest(1, ceil(len(a) * 6 / 10)))
SELECT doc_id, pub_year FROM r WHERE k <= 20
""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An even share of each year of the works that match a request."""
    return providers.TableSearch(tables.text_works(spark, sf_dir)).search(_KEYWORDS, 60, [2018, 2019, 2020], False).select("doc_id", "pub_year")


# --- vectors --------------------------------------------------------------------------------

_QUERY = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]


@query(f"""
WITH {tables.VECTORS_SQL}, s AS (SELECT doc_id, list_inner_product(vector, {_QUERY}) / sqrt(list_inner_product(vector, vector) * list_inner_product({_QUERY}, {_QUERY})) AS similarity FROM vectors)
SELECT doc_id, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, doc_id LIMIT 25
""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = selection.similar_to(tables.vectors(spark, sf_dir), "vector", _QUERY).select("doc_id", "similarity")
    return rounded(scored.orderBy(F.col("similarity").desc(), "doc_id").limit(25), "similarity")


def _geometry_sql(past: str) -> str:
    """Centroids, volumes and the outlier threshold from the works that ``past`` names."""
    return f"""
WITH {tables.VECTORS_SQL},
d AS (SELECT doc_id, pub_year, topic_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM vectors),
y AS (SELECT DISTINCT pub_year AS y FROM vectors),
c AS (SELECT topic_id AS t, y, i, sum(x) / count(DISTINCT doc_id) AS m, count(DISTINCT doc_id) AS works FROM d JOIN y ON pub_year < y WHERE {past} GROUP BY ALL),
k AS (SELECT t, y, sqrt(sum(m * m)) AS norm, max(works) AS works FROM c GROUP BY ALL),
n AS (SELECT y, count(*) AS topics FROM k WHERE norm > 1e-12 GROUP BY y),
s AS (SELECT doc_id, topic_id, pub_year, c.t, sum(x * m) / max(norm) AS sim, max(norm) AS norm, max(k.works) AS works FROM d JOIN c ON pub_year = c.y AND d.i = c.i JOIN k ON c.t = k.t AND c.y = k.y GROUP BY ALL),
g AS (SELECT doc_id, max(sim) FILTER (t = topic_id) AS own, max(norm) FILTER (t = topic_id) AS density, max(sim) FILTER (t <> topic_id) AS nearest, max(works) FILTER (t = topic_id) AS volume FROM s GROUP BY doc_id),
v AS (SELECT doc_id, pub_year, 1 - coalesce(own, 0) AS novelty, coalesce(own, 0) AS own, coalesce(density, 0) AS density, CASE WHEN topics >= 2 THEN coalesce(nearest, 0) ELSE 0 END AS nearest, coalesce(topics >= 2, false) AS others, coalesce(volume, 0) AS volume
  FROM vectors LEFT JOIN g USING (doc_id) LEFT JOIN n ON pub_year = n.y),
q AS (SELECT y, quantile_cont(novelty, 0.95) AS threshold FROM v JOIN y ON pub_year < y WHERE {past} GROUP BY y)
SELECT doc_id, round(novelty, 6) AS novelty_raw, round(own, 6) AS topic_centroid_similarity, round(density, 6) AS cluster_density, cast(volume AS DOUBLE) AS topic_local_volume,
  round(nearest, 6) AS nearest_topic_similarity, round(CASE WHEN others THEN own - nearest ELSE 0 END, 6) AS cross_topic_gap, coalesce(cast(novelty >= threshold AS INTEGER), 0) AS is_outlier_cluster
FROM v LEFT JOIN q ON pub_year = y
"""


def _geometry(spark: SparkSession, sf_dir: str, past: Column | None) -> DataFrame:
    names = ("novelty_raw", "topic_centroid_similarity", "cluster_density", "nearest_topic_similarity", "cross_topic_gap")
    return rounded(text_geometry.text_geometry(tables.vectors(spark, sf_dir), past).drop("pub_year", "topic_id"), *names)


@query(_geometry_sql("true"))
def vector_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(spark, sf_dir, None)


@query(_geometry_sql("doc_id % 5 <> 0"))
def split_aware_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History from four fifths of the works; all works get features."""
    return _geometry(spark, sf_dir, F.col("doc_id") % 5 != 0)


@query()
def text_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.text_works(spark, sf_dir).withColumn("text", texts.title_and_abstract(F.col("title"), F.col("abstract_text")))
    # texts are hashed once; all else reads the vectors
    hashed = scratch.materialise(text_geometry.hashed_vectors(works).select("doc_id", "topic_id", "pub_year", "vector"), "hashed")
    found = text_geometry.text_geometry(hashed)
    return rounded(found, "novelty_raw", "topic_centroid_similarity", "cluster_density", "nearest_topic_similarity", "cross_topic_gap")


@query(f"""
WITH RECURSIVE {tables.VECTORS_SQL},
p AS (SELECT doc_id, 100.0 - doc_id % 97 AS confidence, vector, row_number() OVER (ORDER BY 100.0 - doc_id % 97 DESC, doc_id) AS k FROM vectors QUALIFY k <= 240),
s AS (SELECT a.k, any_value(a.doc_id) AS doc_id, any_value(a.confidence) AS confidence, list(list_inner_product(a.vector, b.vector) ORDER BY b.k) AS sims FROM p a, p b GROUP BY a.k),
step AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS chosen, []::DOUBLE[] AS most
  UNION ALL
  SELECT s.k, CASE WHEN takes THEN list_append(chosen, s.k) ELSE chosen END, CASE WHEN takes THEN list_append(most, sim) ELSE most END
  FROM (SELECT step.*, s.k AS next, coalesce(list_max(list_transform(chosen, lambda c: s.sims[c])), 0) AS sim, len(chosen) < 15 AND coalesce(list_max(list_transform(chosen, lambda c: s.sims[c])), 0) <= 0.78 AS takes FROM step JOIN s ON s.k = step.k + 1) t JOIN s ON s.k = t.next
),
last AS (SELECT * FROM step ORDER BY k DESC LIMIT 1),
e AS (SELECT unnest(chosen) AS k, unnest(most) AS sim, unnest(range(1, len(chosen) + 1)) AS rank FROM last)
SELECT doc_id, cast(confidence AS DOUBLE) AS confidence, round(sim, 6) AS diversity_max_similarity, cast(rank AS INTEGER) AS rank FROM e JOIN s USING (k)
""")
def diverse_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("doc_id", (100.0 - F.col("doc_id") % 97).alias("confidence"), F.concat(F.lit("work "), F.col("doc_id").cast("string")).alias("text"), "vector")
    return selection.diverse_top(rows)


# --- model ----------------------------------------------------------------------------------


def _works_sql(name: str, *columns: str) -> str:
    return f"(SELECT doc_id, {', '.join(columns)} FROM ({works_queries.ORACLE_SQL[name]}))"


_FEATURE_PARTS = {
    "reference_features": ("reference_count", "has_reference_list"),
    "citation_features": ("citation_velocity", "citation_acceleration"),
    "topic_dynamics": ("topic_historical_volume", "topic_publication_growth", "topic_growth_acceleration", "topic_age_years"),
    "author_dynamics": ("author_growth_rate", "author_growth_acceleration", "historical_author_count"),
    "topic_domain_ppmi": ("ppmi_domain_score", "topic_domain_rarity", "domain_history_count", "topic_domain_age_years"),
    "source_history": ("source_history_count", "source_novelty", "topic_source_diversity"),
    "topic_local_volume": ("topic_local_volume",),
    "emergence_label": ("target_emergence",),
}
_ROUNDED = ("commercial_maturity_index", "citation_acceleration", "topic_publication_growth", "topic_growth_acceleration", "author_growth_rate", "author_growth_acceleration", "ppmi_domain_score", "topic_domain_rarity", "source_novelty")


@query(
    f"WITH {tables.WORKS_SQL} SELECT works.* EXCLUDE (authors_ids, referenced_works_ids) REPLACE (round(commercial_maturity_index, 6) AS commercial_maturity_index), "
    + ", ".join(c for columns in _FEATURE_PARTS.values() for c in columns)
    + " FROM works "
    + " ".join(f"JOIN {_works_sql(name, *columns)} USING (doc_id)" for name, columns in _FEATURE_PARTS.items())
)
def work_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build_features(scratch.materialise(tables.works(spark, sf_dir), "works")), *_ROUNDED)


@query()
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on the years to 1996, scored on 1997, with the greatest contributions."""
    rows = scratch.materialise(model.model_input(build_features(scratch.materialise(tables.works(spark, sf_dir), "works"))), "features")
    split = sampling.temporal_split(F.col("pub_year"), 1996, 1997, 1998)
    fitted = model.train(rows.where(split == "train"), iterations=5, depth=3)
    scored = model.score(rows.where(split == "valid"), fitted, 0.3)
    shap = F.transform(model.contributions(fitted, F.col("features")), lambda e: F.struct(e["feature"].alias("feature"), e["shap"].alias("value")))
    return scored.select("doc_id", "probability", "predicted", selection.top_factors(shap, 3).alias("factors"))
