"""Time-ordered rows and forward windows by row number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: str = "dataset", date: str = "date", tie: str = "commit_id") -> DataFrame:
    """Adds idx, from 0 in each dataset, by date and then key."""
    w = Window.partitionBy(by).orderBy(date, tie)
    return df.withColumn("idx", F.row_number().over(w) - 1)


def windows(df: DataFrame, by: str = "dataset", train: float = 0.5, test: float = 0.1, step: float = 0.1, most: int = 5, least_train: int = 50, least_test: int = 20, sliding: bool = False) -> DataFrame:
    """(dataset, window_id, train_start, train_end, test_start, test_end), ends inclusive and windows counted from 1: the training slice grows or slides, the test slice follows it."""
    part = lambda share, least: F.greatest(F.lit(least), F.floor(F.col("n") * share)).cast("long")
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).select(by, "n", part(train, least_train).alias("a"), part(test, least_test).alias("t"), part(step, 1).alias("s"))
    w = n.withColumn("window_id", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("moved", (F.col("window_id") - 1) * F.col("s")).filter("a + moved + t <= n")
    begin = F.col("moved") if sliding else F.lit(0)
    return w.select(
        by,
        F.col("window_id").cast("long").alias("window_id"),
        begin.cast("long").alias("train_start"),
        (F.col("a") + F.col("moved") - 1).alias("train_end"),
        (F.col("a") + F.col("moved")).alias("test_start"),
        (F.col("a") + F.col("moved") + F.col("t") - 1).alias("test_end"),
    )


def records(rows: DataFrame, wins: DataFrame, by: str = "dataset", date: str = "date", label: str = "label") -> DataFrame:
    """Window sizes, dates and whether both slices have both classes. Windows are a handful per dataset, so the range join's one side is five rows a dataset."""
    j = rows.join(wins, by).filter("idx BETWEEN train_start AND test_end")
    train, test = F.col("idx") <= F.col("train_end"), F.col("idx") >= F.col("test_start")
    agg = []
    for name, on in (("train", train), ("test", test)):
        agg += [
            F.count_if(on).cast("long").alias(f"{name}_size"),
            F.min(F.when(on, F.col(date))).alias(f"{name}_start_date"),
            F.max(F.when(on, F.col(date))).alias(f"{name}_end_date"),
            F.count_distinct(F.when(on, F.col(label))).alias(f"_{name}_classes"),
        ]
    out = j.groupBy(by, "window_id", "train_start", "train_end", "test_start", "test_end").agg(*agg)
    skip = F.when(F.col("_train_classes") < 2, "single_class_train").when(F.col("_test_classes") < 2, "single_class_test")
    return (
        out.withColumn("is_consecutive", F.col("test_start") == F.col("train_end") + 1)
        .withColumn("used_for_modeling", skip.isNull())
        .withColumn("skip_reason", F.coalesce(skip, F.lit("")))
        .drop("_train_classes", "_test_classes")
    )
