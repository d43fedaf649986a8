"""The registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.llm import chat_format, conversation_repair, decontaminate, hard_negatives, jaccard_join, language_id, media_ogg, pii_spans, quality, sentencepieces, suffix_dedup, token_counts, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepieces": sentencepieces.query,
        "op2_media_ogg": media_ogg.query,
        "op3_decontaminate": decontaminate.query,
        "op4_url_filters": url_filters.query,
        "op5_jaccard_join": jaccard_join.query,
        "op6_quality": quality.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_chat_format": chat_format.query,
        "op9_token_counts": token_counts.query,
        "op10_language_id": language_id.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_pii_spans": pii_spans.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": url_filters.oracle(), "op8_chat_format": chat_format.oracle()}
