"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, licenses, line_dedup, mixing, ngram_join, pii, sentencepiece, substring_dedup, toxicity

MODULES = {
    "op1_sentencepiece": sentencepiece, "op2_substring_dedup": substring_dedup, "op3_mix_sources": mixing, "op4_toxicity": toxicity, "op5_ngram_join": ngram_join,
    "op6_license_scan": licenses, "op7_exact_dedup": exact_dedup, "op8_fingerprints": fingerprints, "op9_line_dedup": line_dedup, "op10_pii": pii,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: m.query for k, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: m.SQL for k, m in MODULES.items() if hasattr(m, "SQL")}
