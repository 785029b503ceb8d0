"""A commit feed as a stream: late data bounded by a watermark, duplicates dropped, roll-ups appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.rollup import stats


def windowed_rollup(feed: DataFrame, metric: str = "value", at: str = "ts", key: str = "event_id", by: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Statistics per time window and group over a streaming (or static) frame; each key counts once within the watermark."""
    rows = feed.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    rows = rows.dropDuplicatesWithinWatermark([key]) if feed.isStreaming else rows.dropDuplicates([key])
    out = rows.groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), *stats(metric, ""))
    return out.select(F.col("w.start").alias("window_start"), by, "n", *[c for c in out.columns if c.startswith(metric)])


def write_rollup(rolled: DataFrame, path: str, checkpoint: str):
    """Appends finished windows to Parquet, exactly once: the file sink's log and the checkpoint agree after a restart."""
    return rolled.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
