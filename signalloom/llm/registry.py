"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "license_classifier",
    "language_viterbi",
    "context_hashing",
    "toxicity_ordinal",
    "pii_semicrf",
    "secret_tokens",
    "hypergeometric_shards",
    "positional_index",
    "packing_dp",
    "simhash_bktree",
    "periodic_runs",
    "suffix_dedup",
    "source_divergence",
)


def _all(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), attribute)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
