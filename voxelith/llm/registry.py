"""The corpus queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxelith.llm import chat_format, embedding_dedup, hidden_markov, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op2_hidden_markov": hidden_markov.op2_hidden_markov,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op7_warc": warc.op7_warc,
        "op8_quality_rules": quality_rules.op8_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.SQL, "op8_quality_rules": quality_rules.SQL}
