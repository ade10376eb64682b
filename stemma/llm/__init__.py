"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name and the module that holds it.
MODULES = {
    "op10_lm_scores": "op10_lm",
    "op11_benchmark_decontamination": "op11_benchmark",
    "op12_filter_audit": "op12_audit",
    "op13_centroid_clustering": "op13_centroids",
    "op1_suffix_dedup": "op01_suffix",
    "op2_mix_sources": "op02_mix",
    "op3_bpe_encode": "op03_bpe",
    "op4_simhash_dedup": "op04_simhash",
    "op5_quality_rules": "op05_quality",
    "op6_substring_dedup": "op06_substrings",
    "op7_token_counts": "op07_tokens",
    "op8_embedding_dedup": "op08_embeddings",
    "op9_language_id": "op09_language",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(importlib.import_module(f"{__name__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
