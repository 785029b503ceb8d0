"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next.

1. Language ID rejects documents without a language (no letter, or under 0.4 of the letters in any one language).
2. SimHash near-dedup keeps one document of each class, the one with the least doc_id.
3. Suffix-array dedup removes every byte of 200-byte strings that occur twice or more; characters that lose some of
   their bytes go entirely, and n_chars follows. No document is dropped, also not one left empty.
4. Benchmark decontamination drops contaminated documents.
5. Byte-level BPE returns doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids.

Nulls, ties, repeated rows, empty tables and further columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import op01_simhash, op02_language, op05_suffix, op07_decontaminate, op08_bpe
from gleaner.llm.repeats import Scratch

#: SQL can express neither language spans nor SimHash; the stages are tested against brute-force versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op02_language.confident(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op01_simhash.keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op05_suffix.without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op07_decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op08_bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
