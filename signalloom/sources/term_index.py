"""Search over written postings: texts are cut into terms once, requests are answered by counting.

A posting is a term, a work's key, year and whether the work has what the quality filter asks.
Postings lie in folders by a hash of the term, ordered by term within their files, so a request
reads the folders of its own few terms and, by the files' statistics, little else of them. A
frequent term's postings are dealt over several files. No request reads a text.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import has_quality
from ..functions.texts import query_terms, title_and_abstract
from ..operators.sampling import allocate, quota_sample, seeded_subsample
from .committed import Files
from .scratch import quoted

#: Postings of a folder, about, and of a file.
FOLDER_POSTINGS, FILE_POSTINGS = 4_000_000, 1_000_000
#: Terms wanted of a request's.
TENTHS = 6

_MANIFEST = "_index"


def build(works: DataFrame, path: str, title: str = "title", abstract: str = "abstract_text", key: str = "doc_id", year: str = "pub_year", references: str = "referenced_works_ids") -> TermIndex:
    """Writes the index of works and opens it. Null titles and abstracts have no terms; works
    without terms are in no answer. Works without year are found by ``matches`` alone. Of rows that repeat
    a key, each counts by itself only if they differ in year or quality: a key has a term or not."""
    spark = works.sparkSession
    good = has_quality(quoted(abstract), quoted(references)) if references in works.columns else F.lit(True)
    each = works.select(quoted(key).alias("key"), quoted(year).cast("int").alias("year"), F.coalesce(good, F.lit(False)).alias("good"), F.explode(query_terms(title_and_abstract(quoted(title), quoted(abstract)))).alias("term"))
    total = works.select(F.sum(F.size(F.split(title_and_abstract(quoted(title), quoted(abstract)), r"\s+")))).first()[0] or 0
    folders = max(1, -(-int(total) // FOLDER_POSTINGS))
    files = max(1, -(-int(total) // FILE_POSTINGS))
    placed = each.withColumn("folder", _folder(F.col("term"), folders))
    # a folder's postings go to several files by their keys: one term may be in a third of the works
    dealt = placed.repartition(files, "folder", F.pmod(F.xxhash64("key"), F.lit(max(1, files // folders)))).sortWithinPartitions("folder", "term")
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(f"{path.rstrip('/')}/postings")
    Files(spark, path).write(_MANIFEST, json.dumps({"folders": folders, "key": dict(each.dtypes)["key"]}))
    return TermIndex(spark, path)


def _folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


class TermIndex:
    """Answers from a written index, see ``build``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        found = json.loads(Files(spark, path).read(_MANIFEST))
        self.folders = found["folders"]
        self.postings = spark.read.schema(f"key {found['key']}, year int, good boolean, term string, folder int").parquet(f"{path.rstrip('/')}/postings")

    def terms(self, query: str) -> list[str]:
        """The request's distinct terms: a handful."""
        return list(self.spark.range(1).select(query_terms(F.lit(query))).first()[0])

    def _of(self, terms: list[str]) -> DataFrame:
        folders = [r.f for r in self.spark.range(1).select(F.explode(F.array(*(_folder(F.lit(t), self.folders) for t in terms))).alias("f")).distinct().collect()]
        return self.postings.where(F.col("folder").isin(*folders) & F.col("term").isin(*terms))

    def hits(self, query: str, years: list[int] | None = None, good: bool = False) -> DataFrame:
        """(key, year, hits): how many of the request's terms each work has; works without any are left out."""
        terms = self.terms(query)
        if not terms:
            return self.postings.limit(0).select("key", "year", F.lit(0).cast("long").alias("hits"))
        found = self._of(terms)
        if years is not None:
            found = found.where(F.col("year").isin(*years))
        if good:
            found = found.where("good")
        return found.groupBy("key", "year").agg(F.count_distinct("term").alias("hits"))

    def matches(self, query: str, years: list[int] | None = None, good: bool = False) -> DataFrame:
        """(key, year) of the works that have at least six tenths of the request's terms, and one."""
        wanted = max(1, -(-len(self.terms(query)) * TENTHS // 10))
        return self.hits(query, years, good).where(F.col("hits") >= wanted).select("key", "year")


class IndexedSearch:
    """A search provider over a term index: answers are (doc_id, pub_year), to be joined to the works
    by whoever needs more of them. The limit is shared evenly over the years."""

    def __init__(self, index: TermIndex, works: DataFrame | None = None, seed: int = 42) -> None:
        self.index, self.works, self.seed = index, works, seed

    def search(self, query: str, limit: int, years: list[int], require_references: bool = True) -> DataFrame:
        found = self.index.matches(query, years, require_references).select(F.col("key").alias("doc_id"), F.col("year").alias("pub_year"))
        shares = allocate(self.index.spark.createDataFrame([(y, 1) for y in years], "year int, one int"), limit, "year", "one")
        return quota_sample(found, "pub_year", "doc_id", shares.select(F.col("year").alias("pub_year"), "quota"), self.seed)

    def whole(self, query: str) -> DataFrame:
        """(doc_id) of the works that match a request, whatever their year."""
        return self.index.matches(query).select(F.col("key").alias("doc_id")).distinct()

    def by_topic(self, topic_id: Any, limit: int, years: list[int]) -> tuple[DataFrame, int]:
        """Up to ``limit`` works of a topic, and how many there are; from the works."""
        if self.works is None:
            raise ValueError("topics are searched in works, and none were given")
        found = self.works.where((F.col("topic_id") == topic_id) & F.col("pub_year").isin(*years))
        return seeded_subsample(found, "doc_id", limit, self.seed), found.count()

