"""Tables, and the views of them as works, with the same definitions in DuckDB SQL.

A work has doc_id, pub_year, topic_id, domain_id, source_id, authors_ids, referenced_works_ids,
source_tier, commercial_maturity_index and counts_by_year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; columns that a query doesn't name are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def probe(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Rows and column types of a Parquet table; the count reads footers only."""
    found = spark.read.parquet(path)
    return found.count(), dict(found.dtypes)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per order; its lines are its authors, references and citations."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    each = lines.groupBy("doc_id").agg(
        F.min("l_suppkey").alias("source_id"),
        F.array_sort(F.collect_set("l_suppkey")).alias("authors_ids"),
        F.array_sort(F.collect_list("l_partkey")).alias("referenced_works_ids"),
        F.avg("l_discount").alias("commercial_maturity_index"),
    )
    cited = (
        lines.groupBy("doc_id", F.year("l_shipdate").alias("year"))
        .agg(F.count("*").alias("cited_by_count"))
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("year", "cited_by_count"))).alias("counts_by_year"))
    )
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    both = orders.withColumnRenamed("o_orderkey", "doc_id").join(each, "doc_id", "left").join(cited, "doc_id", "left")
    none = F.array().cast("array<bigint>")
    return both.select(
        "doc_id",
        F.year("o_orderdate").alias("pub_year"),
        F.col("c_nationkey").alias("topic_id"),
        F.col("c_mktsegment").alias("domain_id"),
        "source_id",
        F.coalesce("authors_ids", none).alias("authors_ids"),
        F.coalesce("referenced_works_ids", none).alias("referenced_works_ids"),
        F.col("o_orderpriority").alias("source_tier"),
        "commercial_maturity_index",
        F.coalesce("counts_by_year", F.array().cast("array<struct<year: int, cited_by_count: bigint>>")).alias("counts_by_year"),
    )


WORKS_SQL = """
lines AS (
  SELECT l_orderkey, min(l_suppkey) AS source_id, list_sort(list_distinct(list(l_suppkey))) AS authors_ids,
    list_sort(list(l_partkey)) AS referenced_works_ids, avg(l_discount) AS commercial_maturity_index
  FROM lineitem GROUP BY l_orderkey
),
works AS (
  SELECT o_orderkey AS doc_id, cast(year(o_orderdate) AS INTEGER) AS pub_year, c_nationkey AS topic_id, c_mktsegment AS domain_id, source_id,
    coalesce(authors_ids, []) AS authors_ids, coalesce(referenced_works_ids, []) AS referenced_works_ids,
    o_orderpriority AS source_tier, commercial_maturity_index
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON o_orderkey = l_orderkey
)
"""


def topic_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pub_year, topic_id, domain_id of ``works``, without its lines."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("pub_year"), F.col("c_nationkey").alias("topic_id"), F.col("c_mktsegment").alias("domain_id"), F.col("o_orderpriority").alias("source_tier"))


TOPIC_WORKS_SQL = """
works AS (
  SELECT o_orderkey AS doc_id, cast(year(o_orderdate) AS INTEGER) AS pub_year, c_nationkey AS topic_id, c_mktsegment AS domain_id, o_orderpriority AS source_tier
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)
"""


def line_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per line, without a key: for counts and labels only."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("p_brand").alias("topic_id"), F.year("l_shipdate").alias("pub_year"), F.col("l_suppkey").alias("source_id"))


LINE_WORKS_SQL = """
works AS (
  SELECT p_brand AS topic_id, cast(year(l_shipdate) AS INTEGER) AS pub_year, l_suppkey AS source_id
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
"""


def text_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per document: its source is the topic, its language the domain."""
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        (2017 + F.col("doc_id") % 7).cast("int").alias("pub_year"),
        F.col("source").alias("topic_id"),
        F.col("lang").alias("domain_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("abstract_text"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One work per embedding: its label is the topic."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), (2017 + F.col("vec_id") % 7).cast("int").alias("pub_year"), F.col("label").alias("topic_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


VECTORS_SQL = """
vectors AS (
  SELECT vec_id AS doc_id, cast(2017 + vec_id % 7 AS INTEGER) AS pub_year, label AS topic_id, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS vector
  FROM embeddings
)
"""
