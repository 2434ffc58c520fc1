"""Collecting a corpus by strata: quotas, a resumable seeded sample, and where it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import quota_sample
from ..operators.selection import first_position_last_value


def status(strata: DataFrame, collected: DataFrame) -> DataFrame:
    """(stratum, quota, collected) for every stratum, also those without works."""
    have = collected.groupBy("stratum").agg(F.count("doc_id").alias("collected"))
    return strata.join(have, "stratum", "left").select("stratum", "quota", F.coalesce("collected", F.lit(0)).alias("collected"))


def resume(population: DataFrame, strata: DataFrame, collected: DataFrame, seed: int = 42) -> DataFrame:
    """The works (doc_id, stratum, ...) that fill the strata's quotas and aren't collected yet.

    The order is a hash of seed and id, so stopping and resuming, in whatever steps, ends with
    the works that one run would have taken."""
    open_strata = status(strata, collected).where("collected < quota")
    left = population.join(open_strata.select("stratum"), "stratum", "left_semi").join(collected.select("doc_id"), "doc_id", "left_anti")
    return quota_sample(left, "stratum", "doc_id", open_strata.select("stratum", (F.col("quota") - F.col("collected")).alias("quota")), seed)


def union_works(*parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Works of several searches in the order of the searches and, within one, of ``position``:
    of repeats the last one's values, at the first one's place."""
    every = None
    for i, part in enumerate(parts):
        placed = part.withColumn("position", F.struct(F.lit(i).alias("part"), F.col("position").alias("at")))
        every = placed if every is None else every.unionByName(placed)
    return first_position_last_value(every, key, "position")
