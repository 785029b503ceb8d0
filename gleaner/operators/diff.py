"""Unified diffs and line ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


_HEAD = re.compile("^" + HUNK)
_SIDE = pa.list_(pa.struct([("line", pa.int32()), ("text", pa.string())]))


def number_lines(lines: list[str]) -> tuple[list[dict], list[dict]]:
    """(added, deleted) of a diff's lines. Each side's numbers are the hunk's start and the lines of that side since then."""
    heads = [(i, _HEAD.match(x)) for i, x in enumerate(lines) if x.startswith("@@")]
    heads = [(i, m) for i, m in heads if m]
    if not heads:
        return [], []
    first = np.fromiter((x[:1] == "+" and x[:3] != "+++" for x in lines), dtype=bool, count=len(lines))
    second = np.fromiter((x[:1] == "-" and x[:3] != "---" for x in lines), dtype=bool, count=len(lines))
    at = np.array([i for i, _ in heads])
    is_head = np.zeros(len(lines), dtype=bool)
    is_head[at] = True
    hunk = np.cumsum(is_head) - 1
    sides = []
    for own, other, group in ((first, second, 3), (second, first, 1)):
        counted = np.cumsum(~other & ~is_head)  # lines of this side up to here
        begin = np.array([int(m[group]) for _, m in heads])
        number = begin[hunk] + counted - 1 - counted[at][hunk]
        rows = np.flatnonzero(own & (hunk >= 0) & ~is_head)
        sides.append([{"line": int(number[i]), "text": lines[i][1:]} for i in rows.tolist()])
    return sides[0], sides[1]


def _parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        got = [number_lines(re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", x or ""))) for x in texts.to_pylist()]
        yield pa.StructArray.from_arrays([pa.array([x[0] for x in got], _SIDE), pa.array([x[1] for x in got], _SIDE)], ["added", "deleted"])


_parsed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def parse_unified(df: DataFrame, diff: str = "diff") -> DataFrame:
    """Adds `added` and `deleted`: arrays of (line, text).

    '+' lines are added and '-' lines deleted, but '+++' and '---' count as context; any other line is on both sides; lines
    before the first hunk header are left out; lines end at a line feed, with or without a carriage return before it.
    Linear in the diff, no shuffle; a fold over columns would copy the lines found so far for each line.
    """
    span = "array<struct<line: int, text: string>>"
    parse = F.arrow_udf(_parsed, f"added {span}, deleted {span}")
    return df.withColumn("_p", parse(F.col(diff))).withColumns({"added": F.col("_p.added"), "deleted": F.col("_p.deleted")}).drop("_p")


def hunk_lines(df: DataFrame, keys: list[str], diff: str = "diff", side: str = "new") -> DataFrame:
    """(keys, line): the lines that hunk headers name; a missing span is 1, and span 0 names none."""
    a = 3 if side == "new" else 1
    heads = df.select(*keys, F.explode(F.regexp_extract_all(F.col(diff), F.lit("(" + HUNK + ")"), F.lit(1))).alias("h"))
    begin = F.regexp_extract("h", HUNK, a).cast("int")
    size = F.coalesce(F.regexp_extract("h", HUNK, a + 1).try_cast("int"), F.lit(1))
    ranged = heads.select(*keys, begin.alias("_begin"), size.alias("_size")).filter("_size > 0")
    return ranged.select(*keys, F.explode(F.sequence(F.col("_begin"), F.col("_begin") + F.col("_size") - 1)).alias("line")).distinct()


def impacted_lines(changes: DataFrame, keys: list[str], diff: str = "diff", side: str = "new") -> DataFrame:
    """Added (or deleted) lines together with the hunks' lines."""
    which = "added" if side == "new" else "deleted"
    own = parse_unified(changes, diff).select(*keys, F.explode(which).alias("x")).select(*keys, F.col("x.line").alias("line"))
    return own.union(hunk_lines(changes, keys, diff, side)).distinct()


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether [a, b] and [c, d] meet."""
    return F.greatest(a, c) <= F.least(b, d)


def methods_on_lines(methods: DataFrame, lines: DataFrame, on: str = "file", bucket: int = 64) -> DataFrame:
    """Methods with an impacted line in [start, end].

    A semi-join on file and line bucket, with the exact bounds as its condition: a file's methods and lines meet only
    within `bucket` lines of each other, so a large file costs no product.
    """
    spread = methods.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))))
    at = lines.select(F.col(on).alias("_file"), F.col("line").alias("_line"), F.floor(F.col("line") / bucket).alias("_at"))
    hit = (F.col(on) == F.col("_file")) & (F.col("_bucket") == F.col("_at")) & F.col("_line").between(F.col("start"), F.col("end"))
    return spread.join(at, hit, "left_semi").drop("_bucket").distinct()
