"""Univariate scores and classifier metrics, as window and aggregate expressions.

Input is long: (by..., x, y), with y a 0/1 label. Degenerate groups score 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _tied(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per distinct value: its count (t), its positives (p) and the average rank of its peers (r)."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("y").cast("long")).alias("p"))
    before = F.sum("t").over(Window.partitionBy(*by).orderBy(value)) - F.col("t")
    return ties.withColumn("r", before + (F.col("t") + 1) / F.lit(2.0))


def rank_statistics(df: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """(by, n, n1, n0, distinct, u, tied): what Spearman, Kendall and AUC need, from one pass over distinct values."""
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value) & F.col("y").isNotNull())
    t, p, r = F.col("t").cast("double"), F.col("p").cast("double"), F.col("r")
    agg = _tied(valid, by, value).groupBy(*by).agg(
        F.sum(t).alias("n"),
        F.sum(p).alias("n1"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(p * r).alias("r1"),
        F.sum(t * (t - 1) / 2).alias("tied"),
        F.sum(t * r * r).alias("rr"),
    )
    return agg.withColumn("n0", F.col("n") - F.col("n1")).withColumn("u", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)


def _fine(least: int = 3) -> Column:
    return (F.col("n") >= least) & (F.col("distinct") > 1) & (F.col("n1") > 0) & (F.col("n0") > 0)


def spearman(df: DataFrame, by: list[str], value: str = "x", absolute: bool = True) -> DataFrame:
    """Correlation of average ranks with the label (the label's ranks are a linear map of it)."""
    mean = (F.col("n") + 1) / 2
    cov = F.col("r1") - F.col("n1") * mean
    var = (F.col("rr") - F.col("n") * mean * mean) * (F.col("n1") * F.col("n0") / F.col("n"))
    s = F.when(_fine(), F.try_divide(cov, F.sqrt(F.when(var > 0, var))))
    return rank_statistics(df, by, value).select(*by, F.coalesce(F.abs(s) if absolute else s, F.lit(0.0)).alias("score"))


def kendall(df: DataFrame, by: list[str], value: str = "x", absolute: bool = True) -> DataFrame:
    """Tau-b with a 0/1 label in closed form."""
    n1, n0, n = F.col("n1"), F.col("n0"), F.col("n")
    s = F.when(_fine(), F.try_divide(2 * F.col("u") - n1 * n0, F.sqrt((n * (n - 1) / 2 - F.col("tied")) * n1 * n0)))
    return rank_statistics(df, by, value).select(*by, F.coalesce(F.abs(s) if absolute else s, F.lit(0.0)).alias("score"))


def auc(df: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """Area under the curve; null with one class."""
    return rank_statistics(df, by, value).select(*by, F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"))


def mutual_information(df: DataFrame, by: list[str], value: str = "x", k: int = 3, seed: int = 0) -> DataFrame:
    """kNN estimate of the mutual information of a continuous value with a class (Ross 2014), by group.

    Neighbours on a line need order and no search: a group goes to one pandas call, whose memory is that of two columns.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(float), rows["y"].to_numpy(int)
        ok = np.isfinite(x)
        return pd.DataFrame([[*key, _mi(x[ok], y[ok], k, seed)]], columns=[*by, "score"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return df.filter("y IS NOT NULL").select(*by, F.col(value).cast("double").alias("x"), F.col("y").cast("int").alias("y")).groupBy(*by).applyInPandas(run, f"{kinds}, score double")


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    inv = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def _within(whole: np.ndarray, s: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each of s how many of `whole` (sorted) are nearer than far; bounds are corrected by the distances themselves, since sums round."""
    low, high = np.searchsorted(whole, s - far, side="left"), np.searchsorted(whole, s + far, side="right")
    while (off := (high > low) & (whole[high - 1] - s >= far)).any():
        high = high - off
    while (off := (low < high) & (s - whole[np.minimum(low, len(whole) - 1)] >= far)).any():
        low = low + off
    return high - low


def _mi(x: np.ndarray, y: np.ndarray, k: int, seed: int) -> float:
    if len(x) < 3 or len(np.unique(x)) < 2 or len(np.unique(y)) < 2:
        return 0.0
    x = x / x.std()
    x = x + 1e-10 * max(1.0, np.abs(x).mean()) * np.random.default_rng(seed).standard_normal(len(x))
    parts = []
    whole = np.sort(x)
    for c in np.unique(y):
        s = np.sort(x[y == c])
        if len(s) < 2:
            continue
        kc = min(k, len(s) - 1)
        i = np.arange(len(s))
        # The k-th nearest of a sorted row lies in a stretch of k + 1 that holds the row.
        far = np.full(len(s), np.inf)
        for d in range(kc + 1):
            a, b = i - d, i - d + kc
            fits = (a >= 0) & (b < len(s))
            far[fits] = np.minimum(far[fits], np.maximum(s[i[fits]] - s[a[fits]], s[b[fits]] - s[i[fits]]))
        parts.append((len(s), kc, _within(whole, s, far)))
    n = sum(p[0] for p in parts)
    if not n:
        return 0.0
    mean = lambda f: sum(f(*p) for p in parts) / n
    return max(0.0, float(digamma(np.array([n]))[0] + mean(lambda c, kc, m: c * digamma(np.array([kc]))[0]) - mean(lambda c, kc, m: c * digamma(np.array([c]))[0]) - mean(lambda c, kc, m: digamma(m).sum())))


def confusion(df: DataFrame, by: list[str], truth: str = "y", predicted: str = "p") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    count = lambda c, n: F.count_if(c).cast("long").alias(n)
    return df.groupBy(*by).agg(count(~t & ~p, "tn"), count(~t & p, "fp"), count(t & ~p, "fn"), count(t & p, "tp"))


def gmean(recall1: Column, recall0: Column) -> Column:
    return F.sqrt(recall1 * recall0)


def classifier_metrics(counts: DataFrame) -> DataFrame:
    """Adds gmean, balanced_accuracy, f1, mcc, pd, pf, recall0 and recall1; a rate of nothing is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    recall1, recall0 = rate(tp, tp + fn), rate(tn, tn + fp)
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return counts.withColumns(
        {
            "gmean": gmean(recall1, recall0),
            "balanced_accuracy": (recall1 + recall0) / 2,
            "f1": rate(2 * tp, 2 * tp + fp + fn),
            "mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt(product)), F.lit(0.0)),
            "pd": recall1,
            "pf": rate(fp, fp + tn),
            "recall0": recall0,
            "recall1": recall1,
        }
    )
