"""The corpus pipeline: each stage reads what its predecessor kept.

Toxic documents go, one document of each near-duplicate group stays, contaminated documents go,
secrets are replaced in the texts, and what is left is packed into training sequences.

Every stage takes any table with doc_id, text and n_chars; columns beside them, whatever their
names, stay with their rows in all stages but the last. A null text is treated as an empty one
and stays null. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import common, packing_dp, positional_index, secret_tokens, simhash_bktree, toxicity_ordinal


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go; it is fitted on the labelled documents of sf_dir.
    Null and empty texts and rows without doc_id are scored as any other and never rejected for
    that; repeated rows all stay or all go. Without labels no document goes."""
    model = toxicity_ordinal.train(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return toxicity_ordinal.without_toxic(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the least doc_id, one without
    doc_id only where none has one. Of rows equal in doc_id and text one stays. Null, empty and
    word-less texts are one group."""
    return simhash_bktree.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages contaminate go, with or without doc_id; repeated rows all
    stay or all go. Null and empty texts are never contaminated."""
    return positional_index.decontaminate(docs, common.benchmark(spark, sf_dir))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; n_chars follows. All rows stay, repeats too; null stays null
    and keeps its n_chars."""
    return secret_tokens.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Each row is a document of its own,
    repeats too; a null or empty text is the end token alone, and a null doc_id stays null."""
    return packing_dp.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: A trained classifier and a tokenizer decide; SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialise(docs, f"stage-{name}")
    return docs
