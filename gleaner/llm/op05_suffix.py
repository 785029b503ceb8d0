"""Suffix-array dedup by merging shard Burrows-Wheeler transforms.

Texts are UTF-8 bytes. Pieces (see ``repeats``) leave out what cannot repeat, and pieces that are equal stand for one
string with a weight. The different pieces of branching anchors are dealt into slots of bounded size by their anchor. In a
slot, each shard of pieces is sorted into its own transform: the symbols before its suffixes, in suffix order, and the
last-to-first map. Symbols are ranks of short byte groups, so one step covers several bytes. The shards' transforms are
then merged without their texts: starting from the shards one after another, every step brings the rows into the stable
order of their symbols and moves them along the last-to-first map, which refines the interleave by one more symbol, and
block bounds carry the common prefixes along. After `width` bytes, rows in one block share a prefix of `width` bytes, so
blocks of total weight two or more are the repeated windows.

An anchor with more than `most` different pieces would not fit a slot; its windows are counted by two 64-bit hashes each
instead, in the cluster and pre-aggregated, which gives the same rows in bounded memory.

Defined results: null, empty and shorter texts lose nothing; matches never cross documents; repeated rows count as
occurrences of each other's windows; rows with equal doc_id and different texts are separate; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import repeats
from gleaner.llm.common import bounds, documents, durable, pieces, row_key, sha256_hex, spread_join

WIDTH, GRAM = 200, 64
#: Different pieces in a slot, about: few, so that a slot's arrays stay in the processor's cache and long byte groups have 16-bit ranks.
SLOT = 128
#: Different pieces of one anchor that a slot takes at most: about 5 MB of text, whose merge holds some 0.3 GB.
MOST = 16_000
#: Pieces in a shard, and shards in a slot at most.
SHARD, SHARDS = 64, 16
_SYMBOLS = repeats.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def symbols(data: bytes) -> np.ndarray:
    codes = _SYMBOLS[np.frombuffer(data, dtype=np.uint8)]
    return np.broadcast_to(codes, (2, len(codes)))  # one code a byte, so none can be taken for another


def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, text in enumerate(batch.column("text").to_pylist()):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) >= WIDTH:
            yield i, symbols(data)


def group_ranks(text: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """Ranks of the byte groups that start at each place (cyclic), and the bytes in a group: the most that divide width and have 16-bit ranks."""
    rank, size = text.astype(np.uint16), 1
    for step in (x for x in range(2, 9) if width % x == 0):
        values = np.zeros(len(text), dtype=np.uint64)
        for d in range(step):
            values = (values << np.uint64(8)) | np.roll(text, -d)
        known, at = np.unique(values, return_inverse=True)
        if len(known) > 1 << 16:
            break
        rank, size = at.astype(np.uint16), step
    return rank, size


def refine(before: np.ndarray, last_to_first: np.ndarray, row: np.ndarray, steps: int, blocks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(rows, block of each if asked for) in the order of their first `steps` symbols.

    before: the symbol before each row's suffix; last_to_first: the row of the suffix that begins there; row: the rows to start from.
    """
    block, new = np.zeros(len(row), dtype=np.int32), np.zeros(len(row), dtype=bool)
    for _ in range(steps):
        symbol = before[row]
        order = np.argsort(symbol, kind="stable")
        row = last_to_first[row[order]]
        if blocks:
            symbol, block = symbol[order], block[order]
            new[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
            block = np.cumsum(new, dtype=np.int32)
    return row, block


def transform(rank: np.ndarray, size: int, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's transform: its suffixes in order, the symbol before each, and the last-to-first map as row numbers."""
    n = len(rank)
    place = np.arange(n, dtype=np.int32)
    earlier = np.roll(place, size)
    suffix, _ = refine(rank[earlier], earlier, place, steps, blocks=False)
    number = np.empty(n, dtype=np.int32)
    number[suffix] = place
    return suffix, rank[earlier][suffix], number[earlier[suffix]]


def repeated_windows(strings: list[bytes], weights: list[int], width: int = WIDTH, shard: int = SHARD) -> list[list[tuple[int, int]]]:
    """For each string, runs (first, count) of its windows whose weight over all strings is two or more."""
    text = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings])
    first = np.cumsum(sizes) - sizes
    rank, size = group_ranks(text, width)
    steps = width // size
    suffixes, before, last_to_first = [], [], []
    shard = max(shard, -(-len(strings) // SHARDS))
    for a in range(0, len(strings), shard):
        begin, end = int(first[a]), int(first[a] + sizes[a : a + shard].sum())
        # Groups at a shard's end reach into what follows; no window does, so that is as good as any end mark.
        s, b, lf = transform(rank[begin:end], size, steps)
        suffixes.append(s + np.int32(begin))
        before.append(b)
        last_to_first.append(lf + np.int32(begin))
    suffix = np.concatenate(suffixes)
    row, block = refine(np.concatenate(before), np.concatenate(last_to_first), np.arange(len(text), dtype=np.int32), steps)
    place = suffix[row]
    owner = np.repeat(np.arange(len(strings)), sizes)
    weight = np.where(np.arange(len(text)) - first[owner] <= sizes[owner] - width, np.asarray(weights)[owner], 0)  # no window starts in a string's tail
    twice = np.bincount(block, weights=weight[place]) >= 2
    hit = np.zeros(len(text), dtype=bool)
    hit[place] = twice[block] & (weight[place] > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for a, b in edge.reshape(-1, 2).tolist():  # a tail parts any two strings' runs
        out[owner[a]].append((a - int(first[owner[a]]), b - a))
    return out


_RUNS = "runs array<struct<at: int, n: int>>"


def _texts(docs: DataFrame, width: int) -> DataFrame:
    """(anchor, digest, weight, slot, bytes): the text of each different piece, from the document that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, most=1 << 20)):
            out = []
            for text, reps in zip(batch.column("text").to_pylist(), repeats.lists(batch.column("reps"), "anchor", "digest", "weight", "slot", "pos", "n"), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                out += [(a, d, w, s, data[p : p + n + width - 1]) for a, d, w, s, p, n in zip(*(x.tolist() for x in reps), strict=True)]
            if out:
                a, d, w, s, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(d, pa.int64()), pa.array(w, pa.int64()), pa.array(s, pa.int64()), pa.array(b, pa.binary())], ["anchor", "digest", "weight", "slot", "bytes"]
                )

    return docs.select("text", "reps").mapInArrow(run, "anchor long, digest long, weight long, slot long, bytes binary")


def _merge(width: int):
    def run(rows: pa.Table) -> pa.Table:
        found = repeated_windows(rows.column("bytes").to_pylist(), rows.column("weight").to_pylist(), width)
        runs = pa.array([[{"at": a, "n": n} for a, n in x] for x in found], pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))
        return pa.table({"anchor": rows.column("anchor"), "digest": rows.column("digest"), "runs": runs})

    return run


def _hashed(texts: DataFrame, width: int) -> DataFrame:
    """(h, g, anchor, digest, weight, at): the windows of pieces, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, "bytes", 1 << 20)):
            got = [repeats.window_hashes(symbols(x), 0, len(x) - width + 1, width) for x in batch.column("bytes").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(got)), [len(x[0]) for x in got]))
            h, g = (pa.array(np.concatenate([x[i] for x in got]).view(np.int64)) for i in range(2))
            at = pa.array(np.concatenate([np.arange(len(x[0]), dtype=np.int32) for x in got]))
            yield pa.RecordBatch.from_arrays([h, g, *(batch.column(c).take(row) for c in ("anchor", "digest", "weight")), at], ["h", "g", "anchor", "digest", "weight", "at"])

    return texts.mapInArrow(run, "h long, g long, anchor long, digest long, weight long, at int")


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, slot: int = SLOT, most: int = MOST) -> DataFrame:
    """(key, rid, runs): per document with repeats, runs (at, n) of repeated windows."""
    docs, scratch = repeats.keyed(df, key, text), repeats.Scratch(df.sparkSession)
    found = scratch.keep(repeats.occurrences(docs, read, width, gram), "pieces")
    counts = scratch.keep(repeats.repeated_anchors(found), "counts")
    chosen = scratch.keep(spread_join(found, counts, ["anchor"], "n_pieces"), "chosen")
    scratch.drop("pieces", "counts")

    different = chosen.filter("branches").groupBy("anchor", "digest").agg(F.sum("times").alias("weight"), F.min(F.struct("key", "rid", "pos", "n")).alias("rep"))
    different = scratch.keep(different, "different")
    by_anchor = scratch.keep(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("count"), F.count(F.lit(1)).alias("rows")), "by_anchor")
    n_different = different.count()
    slots = max(1, -(-n_different // slot))
    placed = spread_join(different, by_anchor, ["anchor"], "rows").withColumn("slot", F.when(F.col("count") <= most, F.pmod(F.xxhash64("anchor"), F.lit(slots))).otherwise(-1))
    reps = placed.groupBy("rep.key", "rep.rid").agg(F.collect_list(F.struct("anchor", "digest", "weight", "slot", "rep.pos", "rep.n")).alias("reps"))
    texts = scratch.keep(_texts(repeats.same_row(docs, reps, n_different), width), "texts")

    merged = texts.filter("slot >= 0").groupBy("slot").applyInArrow(_merge(width), f"anchor long, digest long, {_RUNS}")
    large = texts.filter("slot < 0")
    windows = _hashed(large, width)
    twice = windows.groupBy("h", "g").agg(F.sum("weight").alias("weight")).filter("weight > 1").select("h", "g")
    counted = windows.join(twice, ["h", "g"]).groupBy("anchor", "digest").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("runs"))
    found = merged.unionByName(counted).filter("size(runs) > 0").join(different.select("anchor", "digest", "weight"), ["anchor", "digest"])
    verdicts = scratch.keep(found, "verdicts")
    scratch.drop("texts", "different", "by_anchor")

    parts = spread_join(chosen.filter("branches AND times = 1"), verdicts, ["anchor", "digest"], "weight").select("key", "rid", F.explode(F.transform("runs", lambda r: F.struct((F.col("pos") + r["at"]).alias("at"), r["n"].alias("n")))).alias("run"))
    whole = chosen.filter("NOT branches OR times > 1").select("key", "rid", F.struct(F.col("pos").alias("at"), (F.col("n") * F.col("times")).alias("n")).alias("run"))
    # A document's own runs: no more than it is long.
    spans = durable(whole.unionByName(parts).groupBy("key", "rid").agg(F.collect_list("run").alias("runs")))
    scratch.drop("chosen", "verdicts")
    return spans


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, with_text: bool = True, with_row: bool = False) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, the remaining bytes (kept) and their whole characters (kept_text) if with_text, and the row itself as a struct (row) if with_row."""
    spans = repeated_spans(df, key, text, width, gram)
    entries = spans.agg(F.sum(F.size("runs"))).first()[0] or 0
    docs = df.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("rid"), F.struct("*" if with_row else F.col(text)).alias("row"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, runs in batches:
            for x, y in bounds(texts):
                out: list[tuple] = []
                for t, spans in zip(texts.slice(x, y - x).to_pylist(), repeats.lists(runs.slice(x, y - x), "at", "n"), strict=True):
                    data = (t or "").encode("utf-8", "surrogatepass")
                    b, e = repeats.covered(*(v.astype(np.int64) for v in spans), width)
                    edges = [0, *np.stack([b, e], axis=1).ravel().tolist(), len(data)]
                    left = b"".join([data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)])
                    out.append((len(data), int((e - b).sum()), len(b), sha256_hex(left), left))
                n, removed, count, sha, left = zip(*out, strict=True)
                columns, names = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns, names = [*columns, pa.array(left, pa.binary()), pa.array([v.decode("utf-8", "ignore") for v in left])], [*names, "kept", "kept_text"]
                yield pa.StructArray.from_arrays(columns, names)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_text
    cut = F.arrow_udf(run, schema).asNondeterministic()
    out = repeats.same_row(docs, spans, entries, "left").select("key", "row", cut(F.col("row").getField(text), "runs").alias("cut"))
    return out.select(F.col("key").alias(key), "cut.*", *["row"] * with_row)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes removed from text, and n_chars to match; characters that lost some of their bytes go entirely. Null texts stay null."""
    out = remove(docs, with_row=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir), with_text=False)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT rid, b, md5(substr(x, 2 * b + 1, 400)) AS win FROM d, unnest(range(0, length(x) // 2 - 199)) AS u(b) WHERE length(x) >= 400),
r AS (SELECT rid, b FROM v WHERE win IN (SELECT win FROM v GROUP BY win HAVING count(*) > 1)),
m AS (SELECT rid, b, coalesce(b > max(b) OVER (PARTITION BY rid ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, true) AS new FROM r),
s AS (SELECT rid, min(b) AS b, max(b) + 200 AS e FROM (SELECT rid, b, sum(new::INT) OVER (PARTITION BY rid ORDER BY b) AS k FROM m) GROUP BY rid, k),
g AS (SELECT rid, b, e, coalesce(lag(e) OVER (PARTITION BY rid ORDER BY b), 0) AS f FROM s),
t AS (SELECT g.rid, sum(e - b) AS n, count(*) AS c, string_agg(substr(x, 2 * f + 1, 2 * (b - f)), '' ORDER BY b) AS head, max(e) AS e FROM g JOIN d USING (rid) GROUP BY g.rid)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
