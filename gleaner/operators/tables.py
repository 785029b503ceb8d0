"""Whole-table operations: output filters, unions, column sets, validation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def function_rows(df: DataFrame) -> DataFrame:
    return df.filter((F.col("snapshot_scope") == "current") & F.col("method_id").isNotNull())


def file_rows(df: DataFrame) -> DataFrame:
    return df.filter((F.col("snapshot_scope") == "current") & (F.col("metric_scope") == "file"))


def write_tables(function: DataFrame, file: DataFrame, commit: DataFrame, base: str, fmt: str = "csv") -> None:
    """Three tables, each written by all executors; missing values are the text None in CSV."""
    for name, df in (("function", function_rows(function)), ("file", file_rows(file)), ("commit", commit)):
        out = df.write.mode("overwrite")
        (out.option("header", True).option("nullValue", "None").csv if fmt == "csv" else out.parquet)(f"{base}_{name}")


def fixed_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns in order, nulls of the given type for missing ones."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def drop_matching(df: DataFrame, patterns: tuple[str, ...] = (r"^parent_", r"^diff_", r"_parent$")) -> DataFrame:
    return df.select(*[c for c in df.columns if not any(re.search(p, c) for p in patterns)])


def union_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_features(wanted: DataFrame, present: DataFrame, feature: str = "feature") -> DataFrame:
    return wanted.select(feature).distinct().join(present.select(feature).distinct(), feature, "left_anti")


def validation_report(df: DataFrame, date: str, label: str, features: list[str]) -> DataFrame:
    """(rule, violations) from one aggregate pass: null dates and labels, other labels than 0 and 1, null or infinite features."""
    known = {c: t for c, t in df.dtypes}
    bad = lambda c: F.col(c).isNull() | ((F.isnan(c) | (F.abs(c) == float("inf"))) if known[c] in ("double", "float") else F.lit(False))
    rules = {"null_date": F.col(date).isNull(), "null_label": F.col(label).isNull(), "other_label": F.col(label).isNotNull() & ~F.col(label).isin(0, 1)}
    rules |= {f"bad_{c}": bad(c) for c in features}
    one = df.agg(*[F.count_if(c).cast("long").alias(k) for k, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])).alias("x")).select("x.*")


def validate(df: DataFrame, date: str, label: str, features: list[str]) -> DataFrame:
    """df, or ValueError with the rules that it breaks."""
    missing = [c for c in (date, label, *features) if c not in df.columns]
    if missing or not features:
        raise ValueError(f"missing columns: {missing}" if missing else "no feature columns")
    other = [c for c in features if dict(df.dtypes)[c] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean") and not dict(df.dtypes)[c].startswith("decimal")]
    if other:
        raise ValueError(f"features that are not numbers: {other}")
    broken = {r.rule: r.violations for r in validation_report(df, date, label, features).collect() if r.violations}
    if broken:
        raise ValueError(f"invalid rows: {broken}")
    return df
