"""Queries over raw records, generated texts, evidence and collections, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates, records, texts
from ..operators import evidence, sampling, selection
from ..sources import sinks, tables
from . import cards as card_rows
from . import collection
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


# --- raw works ------------------------------------------------------------------------------

#: Raw works as an API nests them: an order is a work, its lines are authorships and references.
#: Some lack an id, references or institutions, and some of their abstracts have a gap.
RAW_SQL = """
lines AS (
  SELECT l_orderkey, l_linenumber AS k, l_partkey, l_suppkey, s_name, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
),
each AS (
  SELECT l_orderkey, count(*) AS n, list('A' || l_suppkey ORDER BY k, l_suppkey, l_partkey) AS authors, list('W' || l_partkey ORDER BY k, l_suppkey, l_partkey) AS refs,
    count(*) FILTER (l_suppkey % 5 <> 0) AS listed, count(*) FILTER (l_suppkey % 5 <> 0 AND s_nationkey % 2 = 0) AS companies,
    coalesce(list_sort(list(DISTINCT s_name) FILTER (l_suppkey % 5 <> 0)), []) AS names
  FROM lines GROUP BY l_orderkey
),
raw AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE 'W' || o_orderkey END AS id, cast(year(o_orderdate) AS INTEGER) AS pub_year, o_orderkey % 37 = 0 AS gap,
    CASE o_orderkey % 4 WHEN 0 THEN 'preprint' ELSE 'article' END AS work_type, CASE o_orderkey % 3 WHEN 0 THEN 'journal' WHEN 1 THEN 'conference' ELSE 'repository' END AS source_type,
    'T' || c_nationkey AS topic, 'D' || c_nationkey % 4 AS domain, cast(20 + c_nationkey % 4 AS VARCHAR) AS field, cast(floor(o_totalprice) AS BIGINT) AS cited,
    o_orderpriority || ' ' || o_orderstatus AS abstract, authors, CASE WHEN o_orderkey % 11 = 0 THEN [] ELSE refs END AS refs, coalesce(n, 0) AS n, coalesce(listed, 0) AS listed, coalesce(companies, 0) AS companies, coalesce(names, []) AS names
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN each ON o_orderkey = l_orderkey
)
"""


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records in the nested schema."""
    lines = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    firm = F.struct(F.col("s_name").alias("display_name"), F.when(F.col("s_nationkey") % 2 == 0, "company").otherwise("education").alias("type"))
    author = F.struct(F.concat(F.lit("https://x/A"), F.col("l_suppkey").cast("string")).alias("id"), F.lit("a").alias("display_name"))
    entry = F.struct(author.alias("author"), F.when(F.col("l_suppkey") % 5 != 0, F.array(firm)).otherwise(F.array().cast("array<struct<display_name: string, type: string>>")).alias("institutions"))
    placed = F.struct("l_linenumber", "l_suppkey", "l_partkey", entry.alias("a"), F.concat(F.lit("https://x/W"), F.col("l_partkey").cast("string")).alias("r"))
    each = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(placed)).alias("x")).select("l_orderkey", F.transform("x", lambda e: e["a"]).alias("authorships"), F.transform("x", lambda e: e["r"]).alias("refs"))
    orders = tables.table(spark, sf_dir, "orders").join(tables.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(each, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, nation = F.col("o_orderkey"), F.col("c_nationkey")
    url = lambda kind, x: F.concat(F.lit(f"https://x/{kind}"), x.cast("string"))
    words = F.array(F.col("o_orderpriority"), F.col("o_orderstatus"))
    named = lambda x: F.struct(x.alias("id"))
    return orders.select(
        "o_orderkey",
        F.when(key % 41 != 0, url("W", key)).alias("id"),
        F.lit(None).cast("string").alias("doi"),
        F.year("o_orderdate").alias("publication_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.concat(F.lit("work "), key.cast("string")).alias("title"),
        F.when(key % 4 == 0, "preprint").otherwise("article").alias("type"),
        F.floor("o_totalprice").alias("cited_by_count"),
        texts.inverted_index(words, F.when(key % 37 == 0, 1).otherwise(0)).alias("abstract_inverted_index"),
        F.struct(url("T", nation).alias("id"), F.lit("topic").alias("display_name"), named(url("D", nation % 4)).alias("domain"), named(url("", 20 + nation % 4)).alias("field")).alias("primary_topic"),
        F.array(F.struct(url("T", nation).alias("id"), F.lit("topic").alias("display_name"))).alias("topics"),
        F.array().cast("array<struct<display_name: string>>").alias("keywords"),
        F.lit("en").alias("language"),
        F.struct(F.lit(None).cast("string").alias("landing_page_url"), F.struct(F.lit("S").alias("id"), F.lit("s").alias("display_name"), F.when(key % 3 == 0, "journal").when(key % 3 == 1, "conference").otherwise("repository").alias("type")).alias("source")).alias("primary_location"),
        "authorships",
        F.when(key % 11 == 0, F.array().cast("array<string>")).otherwise(F.col("refs")).alias("referenced_works"),
        F.array().cast("array<struct<year: int, cited_by_count: bigint>>").alias("counts_by_year"),
    )


_TIER = "CASE WHEN work_type = 'preprint' THEN 'preprint' WHEN source_type IN ('journal', 'conference') THEN source_type ELSE 'other' END"
_FIRST = "list_filter(coalesce({0}, []), lambda x, i: list_position({0}, x) = i)"
_COMMON = f"""pub_year, {_TIER} AS source_tier, topic AS primary_topic_id, domain AS domain_id, field AS field_id, array_to_string({_FIRST.format('authors')}, ';') AS authors, array_to_string(names, ';') AS affiliations,
  cited AS citations_at_cutoff, array_to_string(coalesce(refs, []), ';') AS refs, field = '22' AS is_engineering, CASE WHEN n > 0 AND listed = n THEN round(companies / n, 6) END AS commercial_maturity_index, CASE WHEN n > 0 THEN round(listed / n, 6) END AS affiliation_coverage"""


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    joined = rows.withColumns({"authors": F.array_join("authors_ids", ";"), "affiliations": F.array_join("affiliations", ";"), "refs": F.array_join("referenced_works_ids", ";")})
    names = ("doc_id", "abstract_text", "pub_year", "source_tier", "primary_topic_id", "domain_id", "field_id", "authors", "affiliations", "citations_at_cutoff", "refs", "is_engineering", "commercial_maturity_index", "affiliation_coverage")
    return rounded(joined.select(*names, *more), "commercial_maturity_index", "affiliation_coverage")


@query(f"""
WITH {RAW_SQL}
SELECT id AS doc_id, abstract AS abstract_text, {_COMMON}, CASE WHEN pub_year <= 1998 THEN 'pending' ELSE 'future_window_incomplete' END AS target_status, CASE WHEN pub_year <= 1998 THEN 'train_candidates' ELSE 'inference' END AS split
FROM raw WHERE id IS NOT NULL AND NOT gap AND len(refs) > 0 AND pub_year BETWEEN 1996 AND 2000
""")
def normalised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected raw works as rows of the corpus."""
    return _flat(records.corpus_rows(raw_works(spark, sf_dir), 1996, 2000, 1998), "target_status", "split")


@query(f"WITH {RAW_SQL} SELECT id AS doc_id, abstract AS abstract_text, {_COMMON}, cast(len(coalesce(refs, [])) > 0 AS INTEGER) AS has_ref_data, 'q' AS stratum, 'inference' AS target_status FROM raw")
def searched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw works that a search found as rows of the same schema."""
    return _flat(records.inference_rows(raw_works(spark, sf_dir), "q"), "has_ref_data", "stratum", "target_status")


@query("SELECT o_orderkey AS doc_id, CASE y WHEN 1995 THEN 'past_support' WHEN 1996 THEN 'train_candidates' WHEN 1997 THEN 'valid_candidates' WHEN 1998 THEN 'test_candidates' ELSE CASE WHEN y <= 1999 THEN 'train_candidates' ELSE 'inference' END END AS split, CASE WHEN y = 1995 THEN 'past_support_only' WHEN y > 1999 THEN 'future_window_incomplete' ELSE 'pending' END AS target_status FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def year_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = {"past_support_only": (1995,), "train": (1996,), "valid": (1997,), "test": (1998,)}
    year = F.year("o_orderdate")
    return tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), records.split_label(year, roles, 1999).alias("split"), records.target_status(year, roles, 1999).alias("target_status"))


@query(f"WITH {RAW_SQL} SELECT o_orderkey AS doc_id, coalesce(len(abstract) > 0 AND len(refs) > 0, false) AS sound FROM raw")
def sound_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An abstract and a reference."""
    raw = raw_works(spark, sf_dir)
    return raw.select(F.col("o_orderkey").alias("doc_id"), predicates.has_quality(texts.lenient_abstract(F.col("abstract_inverted_index")), F.col("referenced_works")).alias("sound"))


# --- generated texts ------------------------------------------------------------------------

_TITLED = "t AS (SELECT p_partkey AS doc_id, CASE p_partkey % 5 WHEN 0 THEN NULL ELSE p_name END AS source, CASE p_partkey % 8 WHEN 0 THEN 'None' WHEN 1 THEN 'Новый ' || p_name WHEN 2 THEN 'новый метод' WHEN 3 THEN 'Метод' || p_name WHEN 4 THEN p_name || ' of the new kind' WHEN 5 THEN 'Сила 5 кГц и мВт' WHEN 6 THEN 'Конец.начало' ELSE 'наПример' END AS x FROM part)"


@query(rf"""
WITH {_TITLED},
c AS (SELECT *, regexp_replace(trim(x), '(^|[^А-Яа-яЁё])([кмнгдпс]?(Гц|Вт|В|А|Па|Дж|Тл|Ом|См|С)|[кМ]?эВ)($|[^А-Яа-яЁё])', '\1\4', 'g') AS u FROM t),
r AS (SELECT *, regexp_matches(u, '[.!?][а-яё]|[А-Яа-яЁё][A-Za-z]|[A-Za-z][А-Яа-яЁё]') OR regexp_matches(u, '(^|[^А-ЯЁа-яё])[а-яё]+[А-ЯЁ]') AS corrupt, regexp_matches(regexp_extract(x, '[A-Za-zА-Яа-яЁё]'), '[а-яё]') AS small FROM c),
v AS (SELECT *, lower(trim(x)) <> 'none' AND NOT corrupt AND NOT small AS valid FROM r)
SELECT doc_id, corrupt, valid AS valid_text, CASE WHEN source IS NULL THEN lower(trim(x)) = 'none' ELSE valid AND regexp_matches(x, '[А-Яа-яЁё]') AND NOT (len(regexp_extract_all(x, '[A-Za-z]{{2,}}')) >= 4 AND len(regexp_extract_all(x, '[A-Za-z]{{2,}}')) > len(regexp_extract_all(x, '[А-Яа-яЁё]{{2,}}'))) END AS valid_title,
  CASE WHEN source IS NULL THEN lower(trim(x)) = 'none' ELSE valid END AS valid_description FROM v
""")
def generated_text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    kinds = (F.lit("None"), F.concat(F.lit("Новый "), name), F.lit("новый метод"), F.concat(F.lit("Метод"), name), F.concat(name, F.lit(" of the new kind")), F.lit("Сила 5 кГц и мВт"), F.lit("Конец.начало"), F.lit("наПример"))
    rows = tables.table(spark, sf_dir, "part").select(key.alias("doc_id"), F.when(key % 5 != 0, name).alias("source"), F.element_at(F.array(*kinds), (key % 8 + 1).cast("int")).alias("x"))
    x, source = F.col("x"), F.col("source")
    return rows.select("doc_id", predicates.corrupt_text(x).alias("corrupt"), predicates.valid_generated(x).alias("valid_text"), predicates.valid_title(x, source).alias("valid_title"), predicates.valid_description(x, source).alias("valid_description"))


@query("SELECT page_id, sha256('[\"1\",\"' || page_id || '\"]') AS key, left(sha256(url), 16) || '_' || regexp_replace('W/' || page_id, '[^A-Za-z0-9_-]', '_', 'g') || '.json' AS name FROM pages")
def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", texts.cache_key(F.lit("1"), F.col("page_id")).alias("key"), texts.cache_name(F.col("url"), F.concat(F.lit("W/"), F.col("page_id").cast("string"))).alias("name"))


@query(r"SELECT doc_id, trim(array_to_string(string_split_regex(text, '([.!?])\s+')[1:1], ' ')) AS first FROM (SELECT doc_id, regexp_replace(text, '[.!?]+', '.', 'g') AS text FROM documents)")
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to its stop, which is cut off here: SQL's split takes it away."""
    plain = tables.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[.!?]+", ".").alias("text"))
    first = texts.first_sentences(F.col("text"), 1)
    return plain.select("doc_id", F.when(first != F.trim("text"), F.regexp_replace(first, r"\.$", "")).otherwise(first).alias("first"))


@query("SELECT doc_id, array_to_string(list_distinct(list_filter([array_to_string(w[1:k], ' ') FOR k IN list_filter([len(w) - 1, ceil(len(w) * 0.75)::INT, ceil(len(w) * 0.5)::INT, 2, 1], lambda k: k > 0 AND k < len(w))], lambda x: true)).list_sort(), '|') AS variants FROM (SELECT p_partkey AS doc_id, string_split(p_name || ' ' || lower(p_type) || ' of the kind', ' ') AS w FROM part)")
def query_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part")
    asked = F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type"), F.lit(" of the kind"))
    return parts.select(F.col("p_partkey").alias("doc_id"), F.array_join(F.sort_array(texts.query_variants(asked)), "|").alias("variants"))


# --- evidence -------------------------------------------------------------------------------

_YEARS = (2023, 2022, 2021, 2030)


@query("""
WITH w AS (SELECT doc_id, cast(2017 + doc_id % 7 AS INTEGER) AS pub_year FROM documents), c AS (SELECT year, count(doc_id) AS count FROM (SELECT unnest([2023, 2022, 2021, 2030])::INTEGER AS year) LEFT JOIN w ON year = pub_year GROUP BY year),
m AS (SELECT max(count) AS top, greatest(1, ceil(max(count) / 4)) AS rough FROM c), s AS (SELECT top, (SELECT min(k * 10 ** floor(log10(rough))) FROM (SELECT unnest([1, 2, 5, 10]) AS k) WHERE k * 10 ** floor(log10(rough)) >= rough) AS step FROM m)
SELECT year, count, cast(round(10 + (row_number() OVER (ORDER BY year) - 1) * 90 / 3) AS INTEGER) AS x, cast(round(100 - count / greatest(step, ceil(top / step) * step) * 80) AS INTEGER) AS y, cast(step AS BIGINT) AS step, cast(greatest(step, ceil(top / step) * step) AS BIGINT) AS most FROM c, s
""")
def evidence_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = evidence.yearly_counts(tables.text_works(spark, sf_dir), _YEARS)
    return evidence.chart(counts, 10, 100, 20, 100).select("year", "count", "x", "y", "step", F.array_max("ticks").alias("most"))


_ANCHOR, _ANCHOR_VECTOR = "small polished ring", [1.0 if i % 2 else 0.5 for i in range(64)]


@query(f"""
WITH {tables.VECTORS_SQL},
w AS (SELECT v.doc_id, p_name AS title, vector, p_size AS cited, CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id % 9 END AS doi FROM vectors v JOIN part ON p_partkey = doc_id),
s AS (SELECT *, len(list_intersect(list_distinct(string_split(title, ' ')), ['small', 'polished', 'ring'])) AS term_overlap, round(list_inner_product(vector, {_ANCHOR_VECTOR}) / sqrt(list_inner_product(vector, vector) * list_inner_product({_ANCHOR_VECTOR}, {_ANCHOR_VECTOR})), 3) AS similarity FROM w)
SELECT doc_id, term_overlap, similarity FROM s WHERE term_overlap >= 1 AND similarity >= 0.1
""")
def evidence_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that share a term with an anchor and lie near it."""
    works = tables.vectors(spark, sf_dir).join(tables.table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("doc_id"))
    rows = works.select("doc_id", F.col("p_name").alias("title"), F.lit("").alias("abstract"), F.lit("u").alias("url"), "vector")
    return evidence.candidates(rows, _ANCHOR, _ANCHOR_VECTOR, least_terms=1, least_cosine=0.1).select("doc_id", F.col("term_overlap").cast("long").alias("term_overlap"), "similarity")


@query("""
WITH w AS (SELECT p_partkey AS doc_id, round(p_retailprice / 2000, 3) AS similarity, p_size AS cited_by_count, CASE WHEN p_partkey % 4 = 0 THEN 'd' || p_partkey % 9 END AS doi FROM part WHERE p_partkey <> 8),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY coalesce(doi, doc_id::VARCHAR) ORDER BY similarity DESC, cited_by_count DESC, doc_id) = 1)
SELECT doc_id, similarity, cited_by_count FROM f ORDER BY similarity DESC, cited_by_count DESC, doc_id LIMIT 5
""")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = tables.table(spark, sf_dir, "part").select(key.alias("doc_id"), F.round(F.col("p_retailprice") / 2000, 3).alias("similarity"), F.col("p_size").alias("cited_by_count"), F.when(key % 4 == 0, F.concat(F.lit("d"), (key % 9).cast("string"))).alias("doi"))
    return evidence.top_sources(rows, 8).select("doc_id", "similarity", "cited_by_count")


@query("SELECT l_orderkey AS doc_id, array_to_string(list(l_partkey::VARCHAR ORDER BY v DESC, l_partkey::VARCHAR)[1:2], ';') AS factors FROM (SELECT l_orderkey, l_partkey, sum(l_quantity - 25) AS v FROM lineitem GROUP BY ALL) WHERE v > 0 GROUP BY l_orderkey")
def greatest_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity") - 25).alias("v"))
    lists = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.struct(F.col("l_partkey").cast("string").alias("feature"), F.col("v").alias("value"))).alias("x"))
    top = lists.select("doc_id", selection.top_factors(F.col("x"), 2).alias("x")).where(F.size("x") > 0)
    return top.select("doc_id", F.array_join(F.transform("x", lambda e: e["feature"]), ";").alias("factors"))


@query("""
WITH c AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 20)
SELECT 'W' || doc_id AS doc_id, 'result-' || rank AS slug, CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE p_name END AS title, 'https://doi.org/10.1/' || doc_id AS link FROM c JOIN part ON doc_id = p_partkey
""")
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tables.table(spark, sf_dir, "part")
    best = parts.select(F.col("p_partkey").alias("doc_id"), "p_retailprice").orderBy(F.desc("p_retailprice"), "doc_id").limit(20)
    ranked = best.agg(F.collect_list(F.struct((-F.col("p_retailprice")).alias("p"), "doc_id")).alias("x")).select(F.posexplode(F.array_sort("x")).alias("i", "e"))
    work = lambda x: F.concat(F.lit("W"), x.cast("string"))
    chosen = ranked.select(work(F.col("e.doc_id")).alias("doc_id"), (F.col("i") + 1).alias("rank"), F.lit(1.0).alias("confidence"))
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    corpus = parts.select(work(key).alias("doc_id"), F.lit(1).alias("row"), F.when(key % 3 != 0, F.col("p_name")).alias("title"), none.alias("pub_date"), none.alias("source_tier"), none.alias("article_url"), F.concat(F.lit("10.1/"), key.cast("string")).alias("doi"), none.alias("authorships_json"))
    return card_rows.cards(chosen, corpus).select("doc_id", "slug", "title", "link")


# --- collections ----------------------------------------------------------------------------


@query("""
WITH a AS (SELECT event_id % 900 AS doc_id, event_id AS pos, value FROM events WHERE event_type = 'click'), b AS (SELECT event_id % 900 AS doc_id, event_id AS pos, value FROM events WHERE event_type = 'error'),
u AS (SELECT 0 AS part, * FROM a UNION ALL SELECT 1, * FROM b)
SELECT doc_id, min(part * 1000000000 + pos) // 1000000000 AS part, min(part * 1000000000 + pos) % 1000000000 AS place, arg_max(value, part * 1000000000 + pos) AS value FROM u GROUP BY doc_id
""")
def union_of_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeats the last search's values at the first one's place."""
    events = tables.table(spark, sf_dir, "events").select((F.col("event_id") % 900).alias("doc_id"), F.col("event_id").alias("position"), "value", "event_type")
    parts = [events.where(F.col("event_type") == t).drop("event_type") for t in ("click", "error")]
    return collection.union_works(*parts).select("doc_id", F.col("position.part").alias("part"), F.col("position.at").alias("place"), "value")


@query("SELECT topic_id, author, min(y) AS first_year FROM (SELECT c_nationkey AS topic_id, l_suppkey::VARCHAR AS author, cast(year(l_shipdate) AS INTEGER) AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) GROUP BY ALL")
def first_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of first years, brought up to date by what arrived after."""
    lines = tables.table(spark, sf_dir, "lineitem").join(tables.topic_works(spark, sf_dir), F.col("l_orderkey") == F.col("doc_id"))
    seen = lines.select("topic_id", F.col("l_suppkey").cast("string").alias("author"), F.year("l_shipdate").alias("first_year"), (F.col("doc_id") % 2 == 0).alias("known"))
    known = seen.where("known").groupBy("topic_id", "author").agg(F.min("first_year").alias("first_year"))
    return sinks.upsert_first_years(known, seen.where("not known").drop("known"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, o_orderkey % 2 AS late FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY late, o_orderkey) = 1")
def insert_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known rows stay; of new keys the first row comes in."""
    orders = tables.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    known = selection.keep_first(orders.where("o_orderkey % 2 = 0"), "o_custkey", "o_orderkey")
    return sinks.insert_new(known, orders.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


@query("""
WITH p AS (SELECT cast(year(o_orderdate) AS INTEGER) AS year, cast(1 + c_nationkey % 4 AS VARCHAR) AS domain, count(*) AS works, count(*) FILTER (o_orderkey % 9 = 0) AS engineering FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
ye AS (SELECT year, 400.0 / count(*) OVER () AS x FROM (SELECT DISTINCT year FROM p)),
yq AS (SELECT year, floor(x) + cast(row_number() OVER (ORDER BY x - floor(x) DESC, year) <= 400 - sum(floor(x)) OVER () AS INTEGER) AS t FROM ye),
de AS (SELECT p.*, t, t * works / sum(works) OVER (PARTITION BY year) AS x FROM p JOIN yq USING (year)),
q AS (SELECT *, floor(x) + cast(row_number() OVER (PARTITION BY year ORDER BY x - floor(x) DESC, domain) <= t - sum(floor(x)) OVER (PARTITION BY year) AS INTEGER) AS quota FROM de),
e AS (SELECT *, least(quota, ceil(quota * greatest(0.25, engineering / works))) AS part FROM q)
SELECT year || '-' || domain AS stratum, cast(quota AS BIGINT) AS quota, works AS population, quota <= works AS enough FROM e WHERE domain <> '3'
UNION ALL SELECT year || '-3-engineering', cast(part AS BIGINT), engineering, part <= engineering FROM e WHERE domain = '3'
UNION ALL SELECT year || '-3-other', cast(quota - part AS BIGINT), works - engineering, quota - part <= works - engineering FROM e WHERE domain = '3'
""")
def collection_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = tables.topic_works(spark, sf_dir)
    populations = works.groupBy(F.col("pub_year").alias("year"), (1 + F.col("topic_id") % 4).cast("string").alias("domain")).agg(F.count("*").alias("works"), F.count_if(F.col("doc_id") % 9 == 0).alias("engineering"))
    return sampling.strata(populations, 400)


@query("""
WITH r AS (SELECT l_suppkey AS k, l_linenumber AS line, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_returnflag END AS flag FROM lineitem), n AS (SELECT flag, count(*) AS n FROM r GROUP BY flag)
SELECT coalesce(flag, 'none') AS flag, 'train' AS split, cast(round(0.5 * n) AS BIGINT) AS rows FROM n UNION ALL SELECT coalesce(flag, 'none'), 'valid', cast(round(0.8 * n) - round(0.5 * n) AS BIGINT) FROM n UNION ALL SELECT coalesce(flag, 'none'), 'test', cast(n - round(0.8 * n) AS BIGINT) FROM n
""")
def repeated_key_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sizes where keys repeat a thousandfold and a class is null."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("line"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_returnflag")).alias("flag"))
    split = sampling.exact_stratified_split(rows, "flag", "k", {"train": 0.5, "valid": 0.3, "test": 0.2})
    return split.groupBy(F.coalesce("flag", F.lit("none")).alias("flag"), "split").agg(F.count("*").alias("rows"))


@query("SELECT l_returnflag AS stratum, least(500, count(*)) AS rows FROM lineitem GROUP BY ALL")
def repeated_key_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotas are met where a stratum has three keys only."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stratum"), (F.col("l_orderkey") % 3).alias("k"), "l_extendedprice")
    quotas = rows.select("stratum").distinct().withColumn("quota", F.lit(500))
    return sampling.quota_sample(rows, "stratum", "k", quotas).groupBy("stratum").agg(F.count("*").alias("rows"))
