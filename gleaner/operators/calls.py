"""Call resolution and coupling.

A cascade of tiers finds what a call site calls, each an equality of derived keys; the first tier with a hit wins, in it the nearest method to the caller, then the first by (file, start, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.paths import module_and_symbol, python_module, symbol_tail
from gleaner.operators.nearest import nearest_start


def unique_names(methods: DataFrame) -> DataFrame:
    """(name, method): names that occur once."""
    return methods.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("method").alias("method")).filter("n = 1").drop("n")


def resolve_callers(sites: DataFrame, methods: DataFrame) -> DataFrame:
    """(site, caller): exact id; else (file, class, name); else (file, name); nearest start, then order. sites: site, caller_id, file, cls, name, line."""
    none = F.lit("")

    def keyed(tiers: list[tuple[Column, ...]]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), *[c.cast("string").alias(k) for k, c in zip(KEYS, x, strict=True)]) for i, x in enumerate(tiers, 1)])).alias("k")

    def tiers(own: str) -> list[tuple[Column, ...]]:
        file, cls, name = F.col("file"), F.col("cls"), F.col("name")
        return [(F.col(own), none, none), (file, cls, name), (file, none, name)]

    a = sites.select("site", F.col("line").alias("at"), keyed(tiers("caller_id"))).select("site", "at", "k.*")
    b = methods.select(F.col("method").alias("m_id"), F.col("file").alias("m_file"), F.col("start").alias("m_start"), keyed(tiers("method"))).select("m_id", "m_file", "m_start", "k.*")
    return _first(a, b, ["tier", *KEYS], "caller")


#: Parts of a key by which a caller is found.
KEYS = ("by_file", "by_cls", "by_name")


def _first(sites: DataFrame, methods: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(site, tier, method): the best hit of each site by tier, nearness and order. sites: site, at, tier, keys; methods: m_id, m_file, m_start, keys."""
    near = nearest_start(sites, methods, keys, "at", "m_start", ["m_file", "m_start", "m_id"]).withColumnRenamed("at", "_to")
    found = sites.join(near, keys).filter(F.col("at").eqNullSafe(F.col("_to")))
    best = found.groupBy("site").agg(F.min(F.struct("tier", "hit")).alias("b"))
    return best.select("site", F.col("b.tier").alias("tier"), F.col("b.hit.order.m_id.it").alias(name))


def resolve_callees(sites: DataFrame, methods: DataFrame, imports: DataFrame | None = None, within: list[str] = []) -> DataFrame:  # noqa: B006
    """(site, tier, callee). sites: site, file, cls, start, language (of the caller), callee, receiver, inferred, dotted; methods: method, file, cls, name, start, language; imports: file, alias, target.

    `within` names columns of all three that must agree (a snapshot, say). Each side has a row for each key that it has a
    value of; one equi-join on (key number, key) finds all hits, and one aggregate the best of each site.
    """
    spark = sites.sparkSession
    if imports is None:
        imports = spark.createDataFrame([], ", ".join([*(f"{c} {dict(sites.dtypes)[c]}" for c in within), "file string, alias string, target string"]))
    alias = imports.groupBy(*within, "file", "alias").agg(F.max("target").alias("target"))
    named = lambda c, out: alias.select(*within, "file", F.col("alias").alias(c), F.col("target").alias(out))
    s = sites.withColumn("head", F.when(F.col("dotted").contains("."), F.substring_index("dotted", ".", 1)))
    for c, out in (("receiver", "by_receiver"), ("callee", "by_callee"), ("head", "by_head")):
        s = s.join(named(c, out), [*within, "file", c], "left")
    once = methods.groupBy(*within, "name").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(*within, "name", F.lit(True).alias("once"))
    m = methods.join(once, [*within, "name"], "left")

    python = F.col("language") == "python"
    module = F.when(python, python_module(F.col("file")))
    receiver_module, receiver_class = module_and_symbol(F.col("by_receiver"))
    callee_module, callee_symbol = module_and_symbol(F.col("by_callee"))
    head_module, head_class = module_and_symbol(F.col("by_head"))
    own, callee, name = F.nullif(F.col("cls"), F.lit("")), F.col("callee"), F.col("name")
    in_class, in_module, in_both = (own, name), (module, name), (module, own, name)
    only = lambda on, c: F.when(on, c)
    keys = [
        (1, (own, F.col("file"), callee), (own, F.col("file"), name)),
        (2, (F.col("file"), callee), (F.col("file"), name)),
        (3, (symbol_tail(F.col("inferred")), callee), in_class),
        (4, (symbol_tail(F.col("by_receiver")), callee), in_class),
        (5, (symbol_tail(F.col("by_callee")), callee), in_class),
        (6, (module, callee), in_module),
        (7, (only(python, receiver_module), receiver_class, callee), in_both),
        (8, (only(python, F.col("by_head")), callee), in_module),
        (8, (only(python, head_module), head_class, callee), in_both),
        (9, (only(python, callee_module), F.coalesce(callee_symbol, callee)), in_module),
        (10, (only(python, callee_module), callee_symbol, callee), in_both),
        (11, (callee,), (only(F.col("once"), name),)),
    ]

    def keyed(side: int) -> Column:
        """An array of (number, tier, key), without the keys that have a null."""
        every = []
        for i, key in enumerate(keys):
            parts = key[1 + side]
            whole = F.when(F.greatest(*[p.isNull() for p in parts], F.lit(False)) == F.lit(False), F.concat_ws("\x1f", *parts))
            every.append(F.struct(F.lit(i).alias("i"), F.lit(key[0]).alias("tier"), whole.alias("key")))
        return F.explode(F.filter(F.array(*every), lambda x: x["key"].isNotNull())).alias("k")

    a = s.select("site", *within, F.col("start").alias("at"), keyed(0)).select("site", *within, "at", "k.i", "k.tier", "k.key")
    b = m.select(*within, F.col("method").alias("m_id"), F.col("file").alias("m_file"), F.col("start").alias("m_start"), keyed(1)).select(*within, "m_id", "m_file", "m_start", "k.i", "k.key")
    return _first(a, b, [*within, "i", "key"], "callee")


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node", caller: str = "caller", callee: str = "callee") -> DataFrame:
    """(node, in_coupling, out_coupling): distinct callers and callees; a self-call counts on both sides, a lone node 0. Duplicate edges go first, before either side is counted."""
    e = edges.select(caller, callee).distinct()
    out = e.groupBy(F.col(caller).alias(node)).agg(F.count(F.lit(1)).alias("out_coupling"))
    into = e.groupBy(F.col(callee).alias(node)).agg(F.count(F.lit(1)).alias("in_coupling"))
    return nodes.select(node).distinct().join(into, node, "left").join(out, node, "left").fillna(0, ["in_coupling", "out_coupling"])
