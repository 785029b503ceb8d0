"""Methods that a change affects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.paths import class_hint, target_name
from gleaner.operators.nearest import nearest_meeting


def select_candidates(files: DataFrame, methods: DataFrame, hits: DataFrame, changed: DataFrame, key: str = "file") -> DataFrame:
    """(key, name, start, end, reason): what each file's change selects.

    files: (key, added); methods, hits and changed: (key, name, start, end). An added file selects all its methods; else
    line hits and changed methods together, or whichever there is.
    """
    cols = [key, "name", "start", "end"]
    count = lambda df, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    f = files
    for df, n in ((methods, "n_methods"), (hits, "n_hits"), (changed, "n_changed")):
        f = f.join(count(df, n), key, "left").fillna(0, [n])
    reason = (
        F.when(F.col("added") & (F.col("n_methods") > 0), "current_added_file_all_methods")
        .when((F.col("n_hits") > 0) & (F.col("n_changed") > 0), "strict_union_changed_methods")
        .when(F.col("n_hits") > 0, "strict_hits_only")
        .when(F.col("n_changed") > 0, "changed_methods_only")
        .otherwise("empty_no_selected_methods")
    )
    f = f.select(key, reason.alias("reason"))
    pick = lambda df, *reasons: df.select(*cols).join(f.filter(F.col("reason").isin(*reasons)), key)
    some = (
        pick(methods, "current_added_file_all_methods")
        .unionByName(pick(hits, "strict_union_changed_methods", "strict_hits_only"))
        .unionByName(pick(changed, "strict_union_changed_methods", "changed_methods_only"))
    )
    return some.dropDuplicates(cols)


def match_targets(targets: DataFrame, methods: DataFrame, keys: list[str]) -> DataFrame:
    """For each target (keys, name, long_name, start, end) the method that it stands for: same name, then class hint, range overlap, nearest start, first by id.

    A target is compared with the methods of its class where there are any, else with all of its name.
    """
    by = [*keys, "_name"]
    t = targets.distinct().withColumn("_name", target_name(F.col("name")))
    t = t.withColumn("_hint", F.when(F.col("long_name") != "", class_hint(F.coalesce("long_name", F.lit("")), F.col("_name"))))
    m = methods.select(*keys, F.col("name").alias("_name"), F.col("cls").alias("_hint"), "method", "start", "end")
    t = t.join(m.select(*by, "_hint").distinct().withColumn("_known", F.lit(True)), [*by, "_hint"], "left")
    t = t.withColumns({"_all": F.col("_known").isNull(), "_of": F.when(F.col("_known"), F.col("_hint")).otherwise("")})
    per = m.groupBy(*by, "_hint", "start", "end").agg(F.min("method").alias("method"))
    both = F.array(F.struct(F.lit(True).alias("_all"), F.lit("").alias("_of")), F.struct(F.lit(False).alias("_all"), F.col("_hint").alias("_of")))
    near = nearest_meeting(t, per.withColumn("_w", F.explode(both)).select(*by, "_w.*", "start", "end", "method"), [*by, "_all", "_of"], ["method"], otherwise=True)
    near = near.select(*by, "_all", "_of", F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("hit.order.method.it").alias("method"))
    found = t.join(near, [*by, "_all", "_of"]).filter(F.col("start").eqNullSafe(F.col("_start")) & F.col("end").eqNullSafe(F.col("_end")))
    return found.select(*targets.columns, "method")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, to: str, tie: str, id_: str) -> DataFrame:
    """For each row of left (identified by id_) the row of right with the same keys whose `to` is nearest to its `at`, ties by `tie`. One aggregate, no sort."""
    other = F.struct(F.abs(F.col(to) - F.col(at)).alias("_far"), F.col(tie).alias("_tie"), F.struct(*[c for c in right.columns if c not in keys]).alias("_row"))
    best = left.join(right, keys).groupBy(id_).agg(F.min(other).alias("_b"))
    return best.select(id_, "_b._row.*", F.col("_b._far").alias("distance"))


def first_per_commit(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
