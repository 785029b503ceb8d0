"""SimHash near-duplicate classes by tiled exact comparison.

Fingerprints: a bit is 1 if it is set in over half the XXH64 values (seed 42) of a text's three-word shingles, repeats
included. Equal fingerprints are brought together first, so copies cost one row afterwards. Two fingerprints within
`radius` bits agree in at least one of radius + 1 blocks of their bits, so fingerprints are dealt out by block and value;
each such bucket is cut into tiles of about `tile` fingerprints in order of their population counts. A pair of tiles is
compared only if its population counts come within the radius: numpy exclusive-or of all against all, then bit counts.
A pair of tiles returns links that span the classes it found, never all pairs, and connected components unite them.

Defined results: null and empty texts have no words and the fingerprint zero, which links like any other; shorter texts
are one shingle; rows with equal doc_id are separate rows of one class if they link; a null doc_id gets the class of its
fingerprint and names none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, documents, durable, pieces, row_key, spread_join
from gleaner.llm.components import components

RADIUS = 3
#: Fingerprints in a tile.
TILE = 4096
#: Bytes of a text cut into words at once.
STRETCH = 1 << 21
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: For each byte, its bits as eight counters of one byte each.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def stretches(data: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """Words of data, about `size` bytes at a time."""
    begin = 0
    while begin < len(data):
        end = begin + size
        cut = _SPACE.search(data, end) if end < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[begin:end].split()
        begin = end


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    rows = _SPREAD[np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(rows, np.arange(0, len(rows), 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The signed 64-bit form of a text's fingerprint."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    hash_of, counts, total, carry, seen = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64), 0, [], 0
    for words in stretches(data):
        seen += len(words)
        words = carry + words
        if len(words) >= width:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
            starts = [0, *ends[: len(words) - width].tolist()]
            digests = [hash_of(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
            counts += _bit_counts(digests)
            total += len(digests)
        carry = words[-(width - 1) :] if width > 1 else []
    if 0 < seen < width:
        counts, total = _bit_counts([hash_of(b" ".join(carry), 42)]), 1
    bits = np.packbits(2 * counts > total) if total else np.zeros(8, dtype=np.uint8)
    return int(bits.view(">i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """Rows (key, fp)."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            found = [fingerprint(x, width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.int64())], ["key", "fp"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long")


class _Forest:
    """Spanning links among the rows of one pair of tiles."""

    def __init__(self, fp: np.ndarray):
        self.fp, self.label, self.links = fp, np.arange(len(fp)), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            low, high = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((low, high))
            first = order[np.append(True, np.diff(high[order]) > 0)]  # each label joins the least one that it touches
            self.links.append(np.stack([self.fp[i[first]], self.fp[j[first]]]))
            to = np.arange(len(self.label))
            to[high[first]] = low[first]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def compare(fp: np.ndarray, side: np.ndarray | None, radius: int, step: int = 256) -> np.ndarray:
    """Links (2 x n) that span the classes of fp under `radius` bits; with side, only rows of different sides are compared."""
    count = np.bitwise_count(fp)
    order = np.argsort(count, kind="stable")
    fp, count, forest = fp[order], count[order].astype(np.int16), None
    forest = _Forest(fp)
    side = side[order] if side is not None else None
    for a in range(0, len(fp), step):
        here = fp[a : a + step]
        top = np.searchsorted(count, count[a + len(here) - 1] + radius, side="right")
        for b in range(a, int(top), 4096):
            there = fp[b : min(b + 4096, top)]
            i, j = np.nonzero(np.bitwise_count(here[:, None] ^ there[None, :]) <= radius)
            i, j = i + a, j + b
            ok = i < j
            if side is not None:
                ok &= side[i] != side[j]
            forest.add(i[ok], j[ok])
    return np.concatenate(forest.links, axis=1) if forest.links else np.zeros((2, 0), dtype=fp.dtype)


def _in_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, one, two, tile, fp), sorted by the first three, to links."""

    def handle(group: np.ndarray, tile: np.ndarray, apart: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
        size = np.diff(np.append(edge, len(fp)))
        found = [np.zeros((2, 0), dtype=np.uint64)]
        which = np.repeat(np.arange(len(edge)), size)
        small = (size <= 8)[which] & ~apart
        for d in range(1, min(8, int(size.max()))):
            i = np.flatnonzero(small[:-d] & (which[d:] == which[:-d]))
            hit = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
            found.append(np.stack([fp[hit], fp[hit + d]]))
        for g in np.flatnonzero((size > 8) | apart[edge]):
            a, b = edge[g], edge[g] + size[g]
            found.append(compare(fp[a:b], tile[a:b] if apart[a] else None, radius))
        both = np.concatenate(found, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    kept: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> tuple:
        t = pa.Table.from_batches(parts)
        col = lambda c: t.column(c).to_numpy()
        return np.stack([col("bucket"), col("one"), col("two")], axis=1), col("tile"), col("one") != col("two"), col("fp").view(np.uint64)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        ends = [tuple(b.column(c)[x].as_py() for c in ("bucket", "one", "two")) for b, x in ((kept[0], 0), (batch, batch.num_rows - 1))]
        if ends[0] != ends[1]:
            group, tile, apart, fp = joined(kept)
            last = int(np.flatnonzero((group != group[-1]).any(axis=1))[-1]) + 1
            yield handle(group[:last], tile[:last], apart[:last], fp[:last])
            kept = [b for b in pa.Table.from_batches(kept).slice(last).to_batches()]
    if kept:
        yield handle(*joined(kept))


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints of `prints` (column fp, each value once) that span its classes."""
    blocks = radius + 1
    cuts = [round(64 * x / blocks) for x in range(blocks + 1)]
    value = lambda x: F.shiftrightunsigned(F.shiftleft("fp", 64 - cuts[x + 1]), 64 - cuts[x + 1] + cuts[x])
    rows = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*[F.xxhash64(F.lit(x), value(x)) for x in range(blocks)])).alias("bucket"))
    within = Window.partitionBy("bucket").orderBy("ones")
    sizes = rows.groupBy("bucket", "ones").count().withColumn("before", F.sum("count").over(within) - F.col("count"))
    tile_no = lambda place: F.floor(place / F.lit(tile)).cast("int")
    tiles = (
        sizes.select("bucket", "ones", F.explode(F.sequence(tile_no(F.col("before")), tile_no(F.col("before") + F.col("count") - 1))).alias("tile"))
        .groupBy("bucket", "tile")
        .agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
    )
    # A tile meets those after it up to the last one whose counts begin within the radius.
    meets = tiles.alias("x").join(tiles.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("y.tile") >= F.col("x.tile")) & (F.col("y.low") - F.col("x.high") <= radius))
    meets = meets.select(F.col("x.bucket").alias("bucket"), F.col("x.tile").alias("one"), F.col("y.tile").alias("two"))
    member = meets.withColumn("tile", F.explode(F.array_distinct(F.array("one", "two"))))
    placed = rows.join(sizes, ["bucket", "ones"]).select("fp", "bucket", tile_no(F.col("before") + F.pmod(F.xxhash64("fp"), F.col("count"))).alias("tile"))
    dealt = placed.join(member, ["bucket", "tile"]).select("bucket", "one", "two", "tile", "fp")
    dealt = dealt.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return dealt.mapInArrow(lambda it: _in_groups(it, radius), "a long, b long")


def near_classes(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE, width: int = 3) -> DataFrame:
    """Per row of df: key, fp and component, the least key of its class."""
    prints = durable(fingerprints(df, key, text, width))
    distinct = durable(prints.groupBy("fp").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows")))
    roots = components(links(distinct.select("fp"), radius, tile), "a", "b")
    united = distinct.join(roots, distinct.fp == roots.node).groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(united, "root").select(F.col("node").alias("fp"), "component")
    classes = durable(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"), "rows"))
    return spread_join(prints, classes, ["fp"], "rows").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, tile: int = TILE, width: int = 3) -> DataFrame:
    """One row of each class of docs: the least key's; of rows with that key, one."""
    keyed = docs.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("rid"), F.col(text).alias("text"))
    prints = durable(fingerprints(keyed.select(F.struct("key", "rid").alias("id"), "text"), "id", "text", width).select("key.key", "key.rid", "fp"))
    distinct = durable(prints.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "rid")).alias("least")))
    roots = components(links(distinct.select("fp"), radius, tile), "a", "b")
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("class"), "least")
    kept = durable(classes.groupBy("class").agg(F.min("least").alias("least")).select("least.key", "least.rid"))
    rows = docs.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("rid"), F.struct("*").alias("row"))
    out = rows.alias("a").join(kept.alias("b"), F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.rid") == F.col("b.rid")), "left_semi")
    if prints.groupBy("key", "rid").count().filter("count > 1").limit(1).count():  # repeated rows: else there is nothing to choose from
        out = out.dropDuplicates(["key", "rid"])
    return out.select("row.*")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
