"""Operators for large training corpora. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from texlith.llm import ann_search, exact_search, html_text, language_id, language_model, line_dedup, packing, sentencepiece_codec, shingle_join, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": language_model.query,
        "op2_best_fit_packing": packing.query,
        "op3_exact_top_k": exact_search.query,
        "op4_token_counts": token_counts.query,
        "op5_line_dedup": line_dedup.query,
        "op6_language_id": language_id.query,
        "op7_html_extraction": html_text.query,
        "op8_sentencepiece": sentencepiece_codec.query,
        "op9_nearest_neighbours": ann_search.query,
        "op10_ngram_jaccard_join": shingle_join.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_top_k": exact_search.ORACLE,
        "op5_line_dedup": line_dedup.ORACLE,
        "op10_ngram_jaccard_join": shingle_join.ORACLE,
    }
