"""Nearest and containing line ranges, exact and without products of a group's rows.

Rows that agree in all that is compared become one first. The nearest start on either side comes from two running windows.
Ranges are stored under the few aligned blocks (of 1, 2, 4, ... lines) that make them up, and meet a line by an equi-join
with the blocks that hold it; each block keeps only its best range. So work grows with rows times the logarithm of lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.diff import overlaps

#: The aligned blocks that make up the lines from p to before q, as (level, block).
BLOCKS = """filter(flatten(transform(
  transform(sequence(0, length(bin(q - p)) - 1), k -> named_struct('k', k, 'l', shiftright(p + shiftleft(1L, k) - 1, k), 'r', shiftright(q, k))),
  x -> array(
    if(x.l < x.r AND x.l % 2 = 1, named_struct('level', x.k, 'block', x.l), NULL),
    if(x.l < x.r AND x.r % 2 = 1, named_struct('level', x.k, 'block', x.r - 1), NULL)))), x -> x IS NOT NULL)"""


def ordered(columns: list[str]) -> Column:
    """Columns as one value whose minimum comes first in their order, nulls last."""
    return F.struct(*[F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("it")).alias(c) for c in columns])


def _far(a: Column, b: Column) -> Column:
    far = F.abs(a - b)
    return F.struct(far.isNull().alias("none"), far.alias("it"))


def _known(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def _running(keys: list[str], order: Column) -> Window:
    """Up to the current row and those at the same place."""
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def nearest_start(points: DataFrame, rows: DataFrame, keys: list[str], at: str, start: str, order: list[str]) -> DataFrame:
    """(keys, at, hit): for each different point the row with its keys that starts nearest, then the first in order.

    hit is (far, order), each of its values as (none, it). A null distance comes last, null keys agree with none.
    """
    p = _known(points, keys).select(*keys, F.col(at).alias("_at")).distinct().withColumn("_asked", F.lit(True))
    r = _known(rows, keys).groupBy(*keys, F.col(start).alias("_at")).agg(F.min(ordered(order)).alias("_order"))
    place = F.when(F.col("_order").isNotNull() & F.col("_at").isNotNull(), F.struct("_at", "_order"))
    u = p.unionByName(r, allowMissingColumns=True).withColumns(
        {
            "_before": F.last(place, ignorenulls=True).over(_running(keys, F.asc("_at"))),
            "_after": F.last(place, ignorenulls=True).over(_running(keys, F.desc("_at"))),
            "_any": F.min("_order").over(Window.partitionBy(*keys)),
        }
    )
    hit = lambda to, o: F.struct(_far(to, F.col("_at")).alias("far"), o.alias("order"))
    near = [F.when(F.col(c).isNotNull() & F.col("_at").isNotNull(), hit(F.col(f"{c}._at"), F.col(f"{c}._order"))) for c in ("_before", "_after")]
    lone = F.when(F.col("_any").isNotNull(), hit(F.lit(None).cast(rows.schema[start].dataType), F.col("_any")))
    return u.filter("_asked").select(*keys, F.col("_at").alias(at), F.coalesce(F.least(*near), lone).alias("hit")).filter("hit IS NOT NULL")


def nearest_meeting(points: DataFrame, rows: DataFrame, keys: list[str], order: list[str], otherwise: bool = False) -> DataFrame:
    """(keys, start, end, hit): for each different range of points the row with its keys that meets it and starts nearest, then the first in order.

    With `otherwise`, rows that don't meet the range follow, then those where a null leaves that open. hit is (class, far,
    order); a null bound is passed over as `overlaps` does, a null distance comes last, null keys agree with none.
    """
    p = _known(points, keys).select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b")).distinct()
    r = _known(rows, keys).groupBy(*keys, F.col("start").alias("_c"), F.col("end").alias("_d")).agg(F.min(ordered(order)).alias("_order"))
    a, b, c, d = (F.col(x) for x in ("_a", "_b", "_c", "_d"))
    hit = lambda kind, to, o: F.struct(kind.alias("class"), _far(to, a).alias("far"), o.alias("order")).alias("hit")

    # Ranges without a start are few once equal ones are one; they are compared one by one.
    meets = overlaps(a, b, c, d)
    pairs = p.filter(a.isNull()).join(r, keys).unionByName(p.filter(a.isNotNull()).join(r.filter(c.isNull()), keys))
    pairs = pairs if otherwise else pairs.filter(meets)
    hits = [pairs.select(*keys, "_a", "_b", hit(F.when(meets, 0).when(~meets, 1).otherwise(2), c, F.col("_order")))]

    # A range without an end has no bound there, but two of them don't settle whether they meet: _way 1 sees rows that have one, _way 2 the others.
    looks = p.filter(a.isNotNull()).withColumn("_way", F.explode(F.when(b.isNull(), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    reach = looks.groupBy(*keys, "_way").agg(F.min("_a").cast("long").alias("_lo"), F.max("_a").cast("long").alias("_hi"))
    way = [*keys, "_way"]
    seen = r.filter(c.isNotNull()).join(reach, keys).filter("_way = 0 OR (_way = 1) = (_d IS NOT NULL)")
    firm = seen.filter("_way < 2 AND (_d IS NULL OR _c <= _d)")
    able = looks.filter("_way < 2 AND (_b IS NULL OR _a <= _b)")

    # Of those that start at the point or after, the nearest meets it or none does.
    after = able.select(*way, "_a").distinct().withColumn("_asked", F.lit(True)).unionByName(firm.groupBy(*way, c.alias("_a")).agg(F.min("_order").alias("_order")), allowMissingColumns=True)
    after = after.withColumn("_next", F.last(F.when(F.col("_order").isNotNull(), F.struct(a.alias("_c"), "_order")), ignorenulls=True).over(_running(way, F.desc("_a")))).filter("_asked AND _next IS NOT NULL")
    after = able.join(after.select(*way, "_a", "_next"), [*way, "_a"]).filter("_b IS NULL OR _next._c <= _b")
    hits.append(after.select(*keys, "_a", "_b", hit(F.lit(0), F.col("_next._c"), F.col("_next._order"))))

    # Of those that start before and reach the point, the latest; a block keeps its latest range, which all its lines share.
    held = firm.selectExpr(*way, "_c", "_order", "greatest(_c, _lo) - _lo AS p", "least(coalesce(_d, _hi), _hi) - _lo + 1 AS q").filter("p < q")
    held = held.select(*way, F.struct((-c.cast("long")).alias("back"), c.alias("_c"), "_order").alias("_last"), F.explode(F.expr(BLOCKS)).alias("_at")).select(*way, "_at.*", "_last")
    held = held.groupBy(*way, "level", "block").agg(F.min("_last").alias("_last"))
    asked = able.select(*way, "_a").distinct().join(reach, way).withColumn("level", F.explode(F.expr("sequence(0, length(bin(_hi - _lo + 1)) - 1)"))).withColumn("block", F.expr("shiftright(_a - _lo, level)"))
    before = asked.join(held, [*way, "level", "block"]).groupBy(*way, "_a").agg(F.min("_last").alias("_last"))
    hits.append(able.join(before, [*way, "_a"]).select(*keys, "_a", "_b", hit(F.lit(0), F.col("_last._c"), F.col("_last._order"))))

    if otherwise:
        plain = seen.select(*way, "_c", *[F.col(f"_order.{x}.it").alias(x) for x in order])
        near = nearest_start(looks, plain, way, "_a", "_c", order)
        some = looks.join(near, [*way, "_a"])
        hits.append(some.select(*keys, "_a", "_b", F.struct(F.when(F.col("_way") < 2, 1).otherwise(2).alias("class"), "hit.far", "hit.order").alias("hit")))
    every = reduce(DataFrame.unionByName, hits)
    return every.groupBy(*keys, F.col("_a").alias("start"), F.col("_b").alias("end")).agg(F.min("hit").alias("hit"))


def smallest_containing(points: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, start, end, hit): for each different range of points the first row in order that holds it whole; hit is that order.

    The starts up to a point's are some aligned blocks; in each, one running minimum over falling ends serves all points.
    """
    p = _known(points, [*keys, "start", "end"]).select(*keys, F.col("start").alias("_a"), F.col("end").alias("_b")).distinct()
    r = _known(rows, [*keys, "start", "end"]).groupBy(*keys, F.col("start").alias("_c"), F.col("end").alias("_d")).agg(F.min(ordered(order)).alias("_order"))
    reach = p.groupBy(*keys).agg(F.min("_a").cast("long").alias("_lo"), F.max("_a").cast("long").alias("_hi"))
    block = [*keys, "level", "block"]
    held = r.join(reach, keys).filter("_c <= _hi").withColumn("level", F.explode(F.expr("sequence(0, length(bin(_hi - _lo + 1)) - 1)")))
    held = held.withColumn("block", F.expr("shiftright(greatest(_c, _lo) - _lo, level)")).filter("block % 2 = 0").select(*block, F.col("_d").alias("_b"), "_order")
    asked = p.join(reach, keys).withColumn("level", F.explode(F.expr("filter(sequence(0, length(bin(_a - _lo + 1)) - 1), k -> shiftright(_a - _lo + 1, k) % 2 = 1)")))
    asked = asked.withColumn("block", F.expr("shiftright(_a - _lo + 1, level) - 1")).select(*block, "_a", "_b")
    u = asked.unionByName(held, allowMissingColumns=True).withColumn("_best", F.min("_order").over(_running(block, F.desc("_b"))))
    best = u.filter("_a IS NOT NULL AND _best IS NOT NULL").groupBy(*keys, "_a", "_b").agg(F.min("_best").alias("hit"))
    return best.select(*keys, F.col("_a").alias("start"), F.col("_b").alias("end"), "hit")
