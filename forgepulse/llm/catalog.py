"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgepulse.llm import (
    alignment,
    byte_bpe,
    fingerprints,
    jaccard_join,
    language,
    license_scan,
    merkle,
    mixing,
    sharding,
    substring_dedup,
    token_counts,
    topk,
    toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_language": language.op3_language,
        "op4_byte_bpe": byte_bpe.op4_byte_bpe,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_sharding": sharding.op8_sharding,
        "op9_topk": topk.op9_topk,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_alignment": alignment.op11_alignment,
        "op12_license_scan": license_scan.op12_license_scan,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.op1_sql(),
        "op8_sharding": sharding.op8_sql(),
        "op9_topk": topk.OP9_SQL,
        "op12_license_scan": license_scan.op12_sql(),
        "op13_merkle": merkle.op13_sql(),
    }
