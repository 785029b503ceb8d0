"""Analysis of a long history in shards of commits, which an interrupted run takes up again."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleaner.plans import analyzer
from gleaner.sources import files
from gleaner.sources.gitlog import GitSource

TABLES = ("function", "file", "commit")


def _written(spark: SparkSession, base: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = [jvm.org.apache.hadoop.fs.Path(f"{base}_{t}/_SUCCESS") for t in TABLES]
    return all(m.getFileSystem(conf).exists(m) for m in marks)


def run(spark: SparkSession, repo: str, base: str, shards: int = 8, resume: bool = True, **options) -> list[int]:
    """Analyses `shards` runs of commits, each into {base}_part_{i}_{table}, then merges them into {base}_{table}.

    With resume, shards whose three tables are complete are not made again. Returns the shards that were made.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark.dataSource.register(GitSource)
    total = spark.read.format("git").option("repo", repo).option("table", "commits").load().count()
    size = -(-total // shards)
    starts = range(0, total, size) if total else range(0)
    made = []
    for i, skip in enumerate(starts):
        if resume and _written(spark, f"{base}_part_{i}"):
            continue
        analyzer.run(spark, repo, f"{base}_part_{i}", skip=skip, limit=size, **options)
        made.append(i)
    for table in TABLES if total else ():
        merged = files.read_shards(spark, [f"{base}_part_{i}_{table}" for i in range(len(starts))])
        merged.write.mode("overwrite").option("header", True).option("nullValue", files.MISSING).csv(f"{base}_{table}")
    return made
