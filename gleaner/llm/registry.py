"""Queries and SQL of the training-data operators, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import op01_simhash, op02_language, op03_quality, op04_substring, op05_suffix, op06_rules, op07_decontaminate, op08_bpe, op09_quotes, op10_license


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op01_simhash.op1_simhash_near_dedup,
        "op2_language_id": op02_language.op2_language_id,
        "op3_quality_classifier": op03_quality.op3_quality_classifier,
        "op4_substring_dedup": op04_substring.op4_substring_dedup,
        "op5_suffix_dedup": op05_suffix.op5_suffix_dedup,
        "op6_quality_rules": op06_rules.op6_quality_rules,
        "op7_benchmark_decontamination": op07_decontaminate.op7_benchmark_decontamination,
        "op8_byte_bpe": op08_bpe.op8_byte_bpe,
        "op9_chat_quotes": op09_quotes.op9_chat_quotes,
        "op10_license_scan": op10_license.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": op04_substring.ORACLE, "op5_suffix_dedup": op05_suffix.ORACLE, "op7_benchmark_decontamination": op07_decontaminate.ORACLE}
