"""Code metrics from counts and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.nearest import nearest_meeting, smallest_containing


def halstead(df: DataFrame, eta1: str = "halstead_eta1", eta2: str = "halstead_eta2", total1: str = "halstead_total1", total2: str = "halstead_total2") -> DataFrame:
    """Adds the published measures from distinct (eta) and total counts of operators and operands; undefined ones are null."""
    e1, e2, n1, n2 = (F.col(c).cast("double") for c in (eta1, eta2, total1, total2))
    vocabulary, length = e1 + e2, n1 + n2
    volume = length * F.log2(F.when(vocabulary > 0, vocabulary))
    difficulty = (e1 / 2) * F.try_divide(n2, e2)
    effort = difficulty * volume
    return df.withColumns(
        {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": effort, "time": effort / 18, "bugs": F.pow(effort, F.lit(2.0 / 3.0)) / 3000}
    )


def global_count(refs: Column, locals_: Column, file: Column, cls: Column, declared: Column, specialised: Column) -> Column:
    """Distinct references that are global: of the file's, class's or declared symbols less the locals, or, without such scopes, all less the locals."""
    known = F.array_except(F.array_union(F.array_union(file, cls), declared), locals_)
    return F.when(specialised, F.size(F.array_intersect(refs, known))).otherwise(F.size(F.array_except(refs, locals_))).cast("long")


def metric_space(methods: DataFrame, spaces: DataFrame, keys: list[str], id_: str, values: list[str]) -> DataFrame:
    """Each method with the values of the overlapping space that starts nearest (ties: first start, then values); none: nulls."""
    s = spaces.select(*keys, "start", "end", F.col("start").alias("_s"), *values)
    near = nearest_meeting(methods, s, keys, ["_s", *values])
    hit = _back(methods, near, keys, id_)
    return methods.join(hit.select(id_, *[F.col(f"b.order.{v}.it").alias(v) for v in values]), id_, "left")


def smallest_enclosing(methods: DataFrame, nodes: DataFrame, keys: list[str], id_: str, node: str = "node", size: str = "size") -> DataFrame:
    """(id, node): the smallest node that contains each method's lines, ties by node."""
    n = nodes.select(*keys, "start", "end", F.col(size).alias("_size"), F.col(node).alias("_node"))
    hit = _back(methods, smallest_containing(methods, n, keys, ["_size", "_node"]), keys, id_)
    return hit.select(id_, F.col("b._node.it").alias(node))


def _back(methods: DataFrame, near: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """(id, b): the first hit of all rows with an id, from the hits of their ranges."""
    n = near.select(*keys, F.col("start").alias("_start"), F.col("end").alias("_end"), "hit")
    found = methods.select(id_, *[c for c in keys if c != id_], "start", "end").join(n, keys)
    return found.filter(F.col("start").eqNullSafe(F.col("_start")) & F.col("end").eqNullSafe(F.col("_end"))).groupBy(id_).agg(F.min("hit").alias("b"))


def hit_rate(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, hits, misses, rate): how often a field has a value, in per cent."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("n"), *[F.count(f).alias(f) for f in fields])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("hits")) for f in fields])).alias("x"))
    return long.select("x.field", "x.hits", (F.col("n") - F.col("x.hits")).alias("misses"), F.coalesce(F.try_divide(100.0 * F.col("x.hits"), F.col("n")), F.lit(0.0)).alias("rate"))
