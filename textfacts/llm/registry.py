"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_chunks, exact_dedup, language, licences, ngram_join, packing, quality, sharding, toxicity, wrappers

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language_mixture": language.op1_language_mixture,
        "op2_wrapper_extract": wrappers.op2_wrapper_extract,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_licence_scan": licences.op5_licence_scan,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_packing": packing.op7_packing,
        "op8_bpe_chunks": bpe_chunks.op8_bpe_chunks,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op6_quality_rules": quality.OP6_SQL}
