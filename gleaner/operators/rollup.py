"""Aggregates by commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import is_added


def stats(metric: str, prefix: str = "current_") -> list[Column]:
    """mean, max, min and population deviation; nulls are left out, no value gives nulls."""
    return [f(metric).alias(f"{prefix}{metric}_{n}") for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_pop))]


def commit_rollup(methods: DataFrame, metrics: list[str], by: str = "commit_id", method: str = "method_id") -> DataFrame:
    """Statistics of the metrics and the count of distinct methods, in one pass."""
    n = F.count_distinct(method)
    return methods.groupBy(by).agg(*[c for m in metrics for c in stats(m)], n.cast("long").alias("modified_method_count_current"), (n > 0).alias("has_modified_methods_current"))


def with_files(method_rollup: DataFrame, files: DataFrame, metrics: list[str], by: str = "commit_id") -> DataFrame:
    """Adds statistics of file metrics, one row a file; commits of either side stay."""
    return method_rollup.join(files.groupBy(by).agg(*[c for m in metrics for c in stats(m)]), by, "full")


def new_files(changes: DataFrame, commits: DataFrame | None = None, by: str = "commit_id") -> DataFrame:
    """Count and share of added files; with commits, 0 for those without files."""
    added = F.count_if(is_added(F.col("change_type"), F.col("old_path"), F.col("new_path")))
    ratio = F.coalesce(F.try_divide(added.cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
    out = changes.groupBy(by).agg(added.cast("long").alias("current_new_file_count"), ratio.alias("current_new_file_ratio"))
    return out if commits is None else commits.select(by).distinct().join(out, by, "left").fillna(0, ["current_new_file_count", "current_new_file_ratio"])


def touched_classes(methods: DataFrame, by: str = "commit_id", file: str = "file", cls: str = "cls") -> DataFrame:
    """Distinct (file, class) pairs with a class that isn't blank."""
    named = F.when(F.trim(F.col(cls).cast("string")) != "", F.struct(file, cls))
    return methods.groupBy(by).agg(F.count_distinct(named).cast("long").alias("class_touched_count_current"))


def classes_by_file(methods: DataFrame, file: str = "file", cls: str = "cls") -> DataFrame:
    return methods.groupBy(file).agg(F.count_distinct(F.when(F.trim(F.col(cls).cast("string")) != "", F.col(cls))).cast("long").alias("file_class"))


def complete(df: DataFrame, prefix: str = "current_") -> DataFrame:
    """Adds is_complete_feature: no null in a column whose name starts with the prefix."""
    ok = F.lit(True)
    for c in df.columns:
        if c.startswith(prefix):
            ok &= F.col(c).isNotNull()
    return df.withColumn("is_complete_feature", ok)


def max_pool(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg(F.max(score).alias(score))


def max_pool_representative(scores: DataFrame, by: list[str], feature: str = "feature", score: str = "score") -> DataFrame:
    """The feature with the greatest score of each group, the first by name on a tie."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(feature).alias("f"))).alias("b")
    return scores.filter(F.col(score).isNotNull()).groupBy(*by).agg(best, F.count(F.lit(1)).alias("members")).select(*by, F.col("b.f").alias("representative"), (-F.col("b.s")).alias(score), "members")


def sum_importance(importances: DataFrame, by: list[str], value: str = "importance") -> DataFrame:
    return importances.groupBy(*by).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias(value))


def members_by_concept(features: DataFrame, concept: str = "concept", feature: str = "feature") -> DataFrame:
    return features.groupBy(concept).agg(F.count(F.lit(1)).alias("member_count"), F.array_join(F.sort_array(F.collect_list(feature)), "|").alias("members"))


def performance_summary(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation; one row has no deviation."""
    return rows.groupBy(*keys).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def median_across(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.median(m).alias(m) for m in metrics])


def metric_matrix(rows: DataFrame, row: str, column: str, columns: list, value: str) -> DataFrame:
    """Mean of value as a matrix with fixed column order."""
    return rows.groupBy(row).pivot(column, columns).avg(value)
