"""Rankings, consensus, rank groups and rank clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consensus(ranks: DataFrame, concept: str = "concept", rank: str = "rank") -> DataFrame:
    """Mean and sample deviation of each concept's ranks over methods, nulls left out, and the dense rank of the mean."""
    agg = ranks.groupBy(concept).agg(F.avg(rank).alias("average_rank"), F.stddev_samp(rank).alias("rank_std"))
    # One row per concept: a few dozen, so one partition ranks them.
    return agg.withColumn("consensus_rank", F.dense_rank().over(Window.orderBy(F.asc_nulls_last("average_rank"))))


def top_rank_frequency(ranks: DataFrame, concept: str = "concept", rank: str = "rank") -> DataFrame:
    one = F.count_if(F.col(rank) == 1).cast("long")
    return ranks.groupBy(concept).agg(
        F.count(rank).alias("dataset_count"), one.alias("rank1_count"), F.avg(F.when(F.col(rank) == 1, 1.0).otherwise(0.0)).alias("rank1_frequency"), F.avg(rank).alias("mean_rank")
    )


def rank_table(ranks: DataFrame, meta: DataFrame, concept: str = "concept") -> DataFrame:
    """Mean ranks with the meta ranking's rank; concepts without one stay."""
    return top_rank_frequency(ranks, concept).join(meta, concept, "left")


def rank_long(local: DataFrame, meta: DataFrame) -> DataFrame:
    """(scope, dataset, concept, rank): local rankings and the meta ranking in one table."""
    return local.select(F.lit("local").alias("scope"), "dataset", "concept", "rank").unionByName(meta.select(F.lit("meta").alias("scope"), F.lit("all").alias("dataset"), "concept", "rank"))


def top_groups(ranking: DataFrame, percents: list[int], rank: str = "rank") -> DataFrame:
    """For each k the features of the best ceil(g * k / 100) of g rank groups; ties stay together."""
    grouped = ranking.withColumn("grp", F.dense_rank().over(Window.orderBy(rank)))
    total = grouped.agg(F.max("grp").alias("total_rank_group_count"))
    ks = ranking.sparkSession.createDataFrame([(k,) for k in percents], "topk_percent int")
    cut = F.least(F.col("total_rank_group_count"), F.greatest(F.lit(1), F.ceil(F.col("total_rank_group_count") * F.col("topk_percent") / 100.0))).cast("int")
    chosen = ks.join(F.broadcast(total)).withColumn("selected_rank_group_count", cut)  # one row joined with the list of k
    return grouped.join(F.broadcast(chosen), F.col("grp") <= F.col("selected_rank_group_count"))


def final_rank(ranking: DataFrame, order: list, name: str = "final_feature_rank") -> DataFrame:
    return ranking.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def common_features(features: DataFrame, dataset: str = "dataset", feature: str = "feature") -> DataFrame:
    """Features that every dataset has."""
    n = features.agg(F.count_distinct(dataset).alias("n"))
    return features.groupBy(feature).agg(F.count_distinct(dataset).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(feature)


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_square_tail(x: float, df: int) -> float:
    """P(X > x), by the series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-15 * abs(total):
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h * front


def kruskal(groups: list[np.ndarray]) -> float:
    """p-value of the Kruskal-Wallis test, with ties."""
    x = np.concatenate(groups)
    order = np.argsort(x, kind="stable")
    _, first, count = np.unique(x[order], return_index=True, return_counts=True)
    rank = np.empty(len(x))
    rank[order] = np.repeat(first + (count + 1) / 2, count)
    n = len(x)
    sums, at = 0.0, 0
    for g in groups:
        sums += rank[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    tie = 1 - (count.astype(float) ** 3 - count).sum() / (n**3 - n) if n > 1 else 0
    return _chi_square_tail((12 / (n * (n + 1)) * sums - 3 * (n + 1)) / tie, len(groups) - 1) if tie > 0 else 1.0


def cliffs_delta(a: np.ndarray, b: np.ndarray) -> float:
    s = np.sort(b)
    return float((np.searchsorted(s, a, side="left") - (len(s) - np.searchsorted(s, a, side="right"))).sum()) / (len(a) * len(b))


def cluster_ranks(values: dict[str, np.ndarray], alpha: float = 0.05, negligible: float = 0.147) -> dict[str, int]:
    """Rank groups from 1, best first: columns in order of their medians are split where between-group variance of ranks
    is greatest, if a Kruskal-Wallis test tells the halves apart and the effect between them is not negligible.

    An own implementation after published descriptions of the non-parametric Scott-Knott effect size difference test; not verified against R.
    """
    names = sorted(values, key=lambda c: (-np.median(values[c]), -values[c].mean(), c))
    groups: list[list[str]] = []

    def split(part: list[str]) -> None:
        if len(part) > 1:
            mid = [float(np.median(values[c])) for c in part]
            mean = sum(mid) / len(mid)
            spread = lambda k: k * (sum(mid[:k]) / k - mean) ** 2 + (len(mid) - k) * (sum(mid[k:]) / (len(mid) - k) - mean) ** 2
            k = max(range(1, len(part)), key=lambda k: (spread(k), -k))
            a, b = (np.concatenate([values[c] for c in p]) for p in (part[:k], part[k:]))
            if kruskal([a, b]) < alpha and abs(cliffs_delta(a, b)) >= negligible:
                split(part[:k])
                split(part[k:])
                return
        groups.append(part)

    split(names)
    return {c: i for i, g in enumerate(groups, 1) for c in g}


def rank_clusters(scores: DataFrame, by: list[str], concept: str = "concept", value: str = "score", higher_is_better: bool = True, alpha: float = 0.05) -> DataFrame:
    """(by, concept, raw_group, rank, cluster): rank groups of each group's concepts. A group's scores are windows x repeats x concepts, so they fit one call."""
    sign = 1.0 if higher_is_better else -1.0

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ranks = cluster_ranks({str(c): sign * g.to_numpy(float) for c, g in rows.groupby("c")["v"]}, alpha) if len(rows) else {}
        return pd.DataFrame([[*key, c, str(r), r, r] for c, r in sorted(ranks.items(), key=lambda x: (x[1], x[0]))], columns=[*by, concept, "raw_group", "rank", "cluster"])

    kinds = "".join(f"`{c}` {scores.schema[c].dataType.simpleString()}, " for c in by)
    rows = scores.filter(F.col(value).isNotNull()).select(*by, F.col(concept).cast("string").alias("c"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}{concept} string, raw_group string, rank int, cluster int")
