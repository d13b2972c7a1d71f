"""The numbered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tomescope.llm import (
    centroids,
    classifier,
    fingerprints,
    html_text,
    near_dups,
    packing,
    quality_rules,
    resample,
    sentence_pieces,
    span_dups,
    suffix_dups,
    token_files,
    topk,
)


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_span_dedup": span_dups.op3_span_dedup,
        "op4_near_dups": near_dups.op4_near_dups,
        "op5_topk": topk.op5_topk,
        "op6_sentence_pieces": sentence_pieces.op6_sentence_pieces,
        "op7_token_files": token_files.op7_token_files,
        "op8_packing": packing.op8_packing,
        "op9_classifier": classifier.op9_classifier,
        "op10_suffix_dedup": suffix_dups.op10_suffix_dedup,
        "op11_resample": resample.op11_resample,
        "op12_centroids": centroids.op12_centroids,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": topk.ORACLE, "op11_resample": resample.ORACLE, "op12_centroids": centroids.ORACLE}
