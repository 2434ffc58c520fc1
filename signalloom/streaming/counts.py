"""Counts of works by topic and year that follow arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import as_year


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def topic_year_counts(works: DataFrame) -> DataFrame:
    """Running counts: a state row per topic and year, updated as works arrive."""
    valid = works.withColumn("pub_year", as_year(F.col("pub_year"))).where("topic_id is not null and pub_year is not null")
    return valid.groupBy("topic_id", "pub_year").agg(F.count("*").alias("n"))


def maintain(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts as a table in memory; the checkpoint resumes where it stopped."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
