"""Star-schema tables seen as commits, methods, changes and call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """dataset, commit_id, author, date, label (0/1), x: one numeric feature."""
    return load(spark, d, "orders").select(
        F.col("o_orderpriority").alias("dataset"),
        F.col("o_orderkey").alias("commit_id"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").alias("date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_totalprice").alias("x"),
    )


def method_rows(spark: SparkSession, d: str) -> DataFrame:
    """commit_id, method_id, file, class, change_type, paths and four metrics."""
    kind = F.when(F.col("l_returnflag") == "A", "ADD").when(F.col("l_returnflag") == "R", "RENAME").otherwise("MODIFY")
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"),
        F.concat_ws("::", "l_linenumber", "l_partkey", "l_suppkey").alias("method_id"),
        F.col("l_partkey").alias("file"),
        F.col("l_suppkey").alias("cls"),
        kind.alias("change_type"),
        F.when(kind != "ADD", F.concat(F.lit("src/p"), F.col("l_partkey"), F.lit(".py"))).alias("old_path"),
        F.concat(F.lit("src/p"), F.col("l_partkey"), F.lit(".py")).alias("new_path"),
        F.col("l_quantity").alias("cc"),
        F.col("l_extendedprice").alias("volume"),
        F.col("l_discount").alias("nargs"),
        F.col("l_tax").alias("nexits"),
    )


def method_spans(spark: SparkSession, d: str) -> DataFrame:
    """file, method, name, cls, start, end."""
    return load(spark, d, "part").select(
        F.col("p_brand").alias("file"),
        F.col("p_partkey").alias("method"),
        F.split("p_type", " ")[0].alias("cls"),
        F.col("p_type").alias("name"),
        (F.col("p_partkey") % 500).cast("int").alias("start"),
        (F.col("p_partkey") % 500 + F.col("p_size")).cast("int").alias("end"),
    )


def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """file, line: each once."""
    part = load(spark, d, "part").select("p_partkey", "p_brand")
    li = load(spark, d, "lineitem").select("l_partkey", "l_linenumber")
    j = li.join(part, li.l_partkey == part.p_partkey)
    return j.select(F.col("p_brand").alias("file"), (F.col("l_partkey") % 500 + F.col("l_linenumber")).cast("int").alias("line")).distinct()


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee; may repeat."""
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("caller"), (F.col("l_partkey") % 100).alias("callee"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """dataset, feature, x, y in long form: two features per commit, 0/1 labels."""
    c = commits(spark, d)
    return c.select("dataset", F.col("label").alias("y"), F.explode(F.map_from_arrays(F.array(F.lit("price"), F.lit("author")), F.array("x", F.col("author").cast("double")))).alias("feature", "x"))
