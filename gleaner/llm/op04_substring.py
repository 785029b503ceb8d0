"""Substring dedup by De Bruijn compaction.

Edges of the graph are k-mers of `width` words, nodes their first and last width - 1 words. Consecutive edges of a text
that share an anchor are one path from the start (see ``repeats``), and equal paths are one row with its number of
occurrences and the source coordinates of its first one, its representative. Paths whose anchor has no other path repeat
whole. All others are undone into their edges, read at the representative's coordinates, and counts by edge find the
repeated ones. Repeated edges and paths are the graph; counts by node give its degrees. What adjoins at a node with one
way in and one way out is compacted, first along the representatives' documents, then by joins that double the reach of
each pointer until every piece knows the first one of its nonbranching path (``compact``).

Paths return to all their occurrences by a join. There the words at the source coordinates are compared, by SHA-256, with
those of the representative, and an occurrence with other words is not removed. Every word covered by a repeated edge is.

Defined results: null, empty and shorter texts lose nothing; a text of any length is read in stretches; repeated rows count
as occurrences of each other's windows; rows with equal doc_id and different texts are separate; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm import repeats
from gleaner.llm.common import documents, durable, pieces, sha256_hex, spread_join

WIDTH = 35
#: Words whose hashes give a window its anchor. Longer ones are rarer, shorter ones make fewer pieces.
GRAM = 8
CACHE = 500_000


class _Words:
    """Two 64-bit codes of words, the halves of a 128-bit hash, remembered up to a bound."""

    known: dict[bytes, int] = {}
    codes = np.zeros((2, 0), dtype=np.uint64)

    @classmethod
    def hashes(cls, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(cls.known)
        if new:
            if len(cls.known) + len(new) > CACHE:
                cls.known, cls.codes = {}, cls.codes[:, :0]
                new = set(words)
            order = list(new)
            cls.known.update(zip(order, range(len(cls.known), len(cls.known) + len(order)), strict=True))
            fresh = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w) for w in order]), dtype=np.uint64).reshape(-1, 2).T
            cls.codes = np.concatenate([cls.codes, fresh], axis=1)
        return cls.codes.take(np.fromiter(map(cls.known.__getitem__, words), dtype=np.int64, count=len(words)), axis=1)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    texts = [(i, words) for i, words in enumerate(map(split, batch.column("text").to_pylist())) if len(words) >= WIDTH]
    yield from zip([i for i, _ in texts], _symbols([words for _, words in texts]), strict=True)


def _symbols(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Of each text; the words of all of them are looked up at once."""
    codes = _Words.hashes([w for words in texts for w in words])
    ends = np.cumsum([0, *map(len, texts)]).tolist()
    return [codes[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _check(words: list[bytes], begin: int, count: int, width: int) -> int:
    """The first 64 bits of the SHA-256 of the words under `count` windows."""
    return int.from_bytes(hashlib.sha256(b" ".join(words[begin : begin + count + width - 1])).digest()[:8], "little", signed=True)


def _segments(docs: DataFrame, width: int) -> DataFrame:
    """The paths of each representative's document with their end nodes and the check of their words, and the edges (check null) of branching ones."""
    fields = ("pos", "n", "times", "anchor", "digest", "branches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, most=1 << 20)):
            texts = [split(t) for t in batch.column("text").to_pylist()]
            columns: list[list] = [[] for _ in range(8)]
            shown: list[tuple] = []
            for i, (words, symbols, lists) in enumerate(zip(texts, _symbols(texts), repeats.lists(batch.column("paths"), *fields), strict=True)):
                if not len(lists[0]):
                    continue
                nodes = repeats.window_hashes(symbols, 0, len(words) - width + 2, width - 1)
                nodes = repeats.mix(nodes[0] ^ (nodes[1] << np.uint64(1)))
                pos, n, times, anchor, digest, branches = lists
                check = np.array([_check(words, p, k, width) for p, k in zip(pos.tolist(), n.tolist(), strict=True)], dtype=np.int64)
                # The paths themselves, then the edges of those that branch.
                which = np.repeat(np.arange(len(pos)), np.where(branches, n, 0))
                first = np.cumsum(np.where(branches, n, 0)) - np.where(branches, n, 0)
                at = np.concatenate([pos, pos[which] + np.arange(len(which)) - first[which]])
                size = np.concatenate([n, np.ones(len(which), dtype=n.dtype)])
                both = np.concatenate([np.arange(len(pos)), which])
                row = anchor[both], digest[both], np.full(len(both), i), at, size, nodes[at], nodes[at + size], times[both]
                for column, values in zip(columns, row, strict=True):
                    column.append(values)
                shown.append((branches[both], check[both], np.arange(len(both)) >= len(pos)))
            if shown:
                anchor, digest, row, at, n, a, b, times = map(np.concatenate, columns)
                branches, check, none = (np.concatenate(x) for x in zip(*shown, strict=True))
                arrays = [pa.array(anchor), pa.array(digest), batch.column("rid").take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
                arrays += [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(times), pa.array(branches), pa.array(check, mask=none)]
                yield pa.RecordBatch.from_arrays(arrays, ["anchor", "digest", "rid", "at", "n", "a", "b", "times", "branches", "check"])

    return docs.select("rid", "text", "paths").mapInArrow(run, "anchor long, digest long, rid long, at int, n int, a long, b long, times long, branches boolean, check long")


def compact(graph: DataFrame, scratch: repeats.Scratch) -> DataFrame:
    """graph with `path`: the same for all its rows on one maximal nonbranching path, one of their ids; kept as `compacted`.

    graph: id (unique), a and b (nodes), n (edges), rid and at (source coordinates).
    """
    inner = graph.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(graph.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    inner = inner.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).filter("out = 1 AND in = 1").select("node")
    along = Window.partitionBy("rid").orderBy("at", "id")
    linked = graph.join(inner.withColumn("joined", F.lit(True)), graph.a == inner.node, "left").drop("node")
    # One document's rows: as many as it is long, and the window streams over them.
    linked = linked.withColumn("first", ~(F.coalesce("joined", F.lit(False)) & F.coalesce((F.lag(F.col("at") + F.col("n")).over(along) == F.col("at")) & (F.lag("b").over(along) == F.col("a")), F.lit(False))))
    linked = scratch.keep(linked.withColumn("part", F.last(F.expr("if(first, id, null)"), ignorenulls=True).over(along)), "linked")
    # Parts end where the next row of their document starts another one, or nowhere.
    ends = linked.groupBy("part").agg(F.max_by("b", "at").alias("b"))
    starts = linked.filter("first AND joined").select(F.col("part").alias("next"), F.col("a"))
    links = starts.join(ends, starts.a == ends.b).filter("next <> part").select(F.col("next").alias("part"), F.col("part").alias("up"))
    heads = linked.filter("first").select("part").join(links, "part", "left")
    now = scratch.keep(heads.select("part", F.coalesce("up", "part").alias("up"), F.col("part").alias("least"), F.col("up").isNull().alias("done")), "heads-0")
    sign, turn = None, 0
    # Unchanged means that what is not done lies on circles, and that each of those knows its least id.
    while (fresh := tuple(now.filter("NOT done").agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("part", "least")), F.sum(F.xxhash64("part", "least").cast("decimal(38,0)"))).first())) != sign and fresh[0]:
        to = now.select(F.col("part").alias("at"), F.col("up").alias("up2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        moved = now.filter("NOT done").join(to, F.col("up") == F.col("at")).select("part", F.col("up2").alias("up"), F.least("least", "least2").alias("least"), F.col("done2").alias("done"))
        sign, turn = fresh, turn + 1
        now = scratch.keep(now.filter("done").unionByName(moved), f"heads-{turn}")
        scratch.drop(f"heads-{turn - 1}")
    names = now.select("part", F.when(F.col("done"), F.col("up")).otherwise(F.col("least")).alias("path"))
    out = scratch.keep(linked.join(names, "part").select(*graph.columns, "path"), "compacted")
    scratch.drop("linked", f"heads-{turn}")
    return out


#: Neighbouring repeated edges on one compacted path become one run (off, m, path).
_RUNS = """aggregate(array_sort(found), cast(array() as array<struct<off: int, m: int, path: bigint>>), (acc, x) ->
  if(size(acc) > 0 and element_at(acc, -1).off + element_at(acc, -1).m = x.off and element_at(acc, -1).path = x.path,
     concat(slice(acc, 1, size(acc) - 1), array(named_struct('off', element_at(acc, -1).off, 'm', element_at(acc, -1).m + 1, 'path', x.path))),
     concat(acc, array(named_struct('off', x.off, 'm', 1, 'path', x.path)))))"""


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, rid, runs): per document with repeats, its runs of repeated edges.

    A run: the piece it lies in (pos, n, check), its edges (at, m; the piece stands `times` times in a row) and its compacted path.
    """
    docs, scratch = repeats.keyed(df, key, text), repeats.Scratch(df.sparkSession)
    found = scratch.keep(repeats.occurrences(docs, read, width, gram), "pieces")
    counts = scratch.keep(repeats.repeated_anchors(found), "counts")
    chosen = scratch.keep(spread_join(found.select("anchor", "digest", "key", "rid", "pos", "n", "times"), counts, ["anchor"], "n_pieces"), "chosen")
    scratch.drop("pieces", "counts")
    paths = chosen.groupBy("anchor", "digest").agg(F.sum("times").alias("times"), F.first("branches").alias("branches"), F.min(F.struct("rid", "key", "pos", "n")).alias("source"))
    paths = scratch.keep(paths.select("source.*", "anchor", "digest", "times", "branches"), "paths")
    n_paths = paths.count()
    # A document's own pieces: as many as it is long.
    sources = paths.groupBy("key", "rid").agg(F.collect_list(F.struct("pos", "n", "times", "anchor", "digest", "branches")).alias("paths"))
    segments = scratch.keep(_segments(repeats.same_row(docs, sources, n_paths), width), "segments")
    # Rows that agree in doc_id and text emit their paths once each.
    whole = segments.filter("check IS NOT NULL").groupBy("anchor", "digest", "times", "branches", "rid", "at", "n", "a", "b").agg(F.min("check").alias("check"))
    edges = segments.filter("check IS NULL")
    twice = edges.groupBy("a", "b").agg(F.sum("times").alias("total"), F.min(F.struct("rid", "at")).alias("source")).filter("total > 1")
    twice = twice.select(F.xxhash64("a", "b").alias("id"), "a", "b", F.lit(1).alias("n"), "source.rid", "source.at", "total")
    kept = whole.filter("NOT branches").select(F.xxhash64("anchor", "digest", "n").alias("id"), "a", "b", "n", "rid", "at", F.lit(None).cast("long").alias("total"))
    graph = compact(scratch.keep(twice.unionByName(kept), "graph"), scratch)
    scratch.drop("graph")
    single = spread_join(edges.filter("times = 1").select("anchor", "digest", "at", "a", "b"), graph.filter("total IS NOT NULL").select("a", "b", "path", "total"), ["a", "b"], "total")
    single = single.groupBy("anchor", "digest").agg(F.collect_set(F.struct(F.col("at").alias("off"), F.lit(1).alias("m"), "path")).alias("found"))
    single = single.select("anchor", "digest", F.expr(_RUNS).alias("found"))
    named = graph.filter("total IS NULL").select("id", "path")
    marked = whole.withColumn("id", F.xxhash64("anchor", "digest", "n")).join(named, "id", "left").join(single, ["anchor", "digest"], "left").filter("NOT branches OR times > 1 OR found IS NOT NULL")
    every = F.array(F.struct(F.col("at").alias("off"), F.col("n").alias("m"), "path"))
    marked = marked.select("anchor", "digest", F.col("at").alias("start"), "check", "times", F.when(~F.col("branches") | (F.col("times") > 1), every).otherwise(F.col("found")).alias("found"))
    marked = scratch.keep(marked.withColumnRenamed("times", "total"), "marked")
    runs = spread_join(chosen.select("anchor", "digest", "key", "rid", "pos", "n", "times"), marked, ["anchor", "digest"], "total").withColumn("run", F.explode("found"))
    at = (F.col("pos") + F.col("run.off") - F.col("start")).alias("at")
    m = F.when(F.col("times") > 1, F.col("n") * F.col("times")).otherwise(F.col("run.m")).alias("m")
    runs = runs.select("key", "rid", F.struct("pos", "n", "times", "check", at, m, "run.path").alias("run"))
    spans = durable(runs.groupBy("key", "rid").agg(F.collect_list("run").alias("runs")))
    scratch.drop("chosen", "paths", "segments", "compacted", "marked")
    return spans


def _verified(words: list[bytes], pos: np.ndarray, n: np.ndarray, times: np.ndarray, check: np.ndarray, width: int) -> np.ndarray:
    """Whether the words of each piece have the check of its path, `times` times in a row."""
    known: dict[tuple[int, ...], bool] = {}
    places = list(zip(pos.tolist(), n.tolist(), times.tolist(), check.tolist(), strict=True))
    for p, k, t, c in places:
        if (p, k, t, c) not in known:
            again = words[p : p + k * (t - 1) + width - 1] == words[p + k : p + k * t + width - 1] if t > 1 else True
            known[p, k, t, c] = again and _check(words, p, k, width) == c
    return np.array([known[place] for place in places], dtype=bool)


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256, and the kept words (kept) and removed spans (begin, end) if with_text."""
    docs = repeats.keyed(df, key, text)
    spans = repeated_spans(df, key, text, width, gram)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            n, removed, sha, kept, cut = [], [], [], [], []
            for text, (*source, at, m) in zip(batch.column("text").to_pylist(), repeats.lists(batch.column("runs"), "pos", "n", "times", "check", "at", "m"), strict=True):
                words = split(text)
                same = _verified(words, *source, width)
                b, e = repeats.covered(at[same].astype(np.int64), m[same].astype(np.int64), width)
                out, at = [], 0
                for x, y in zip(b.tolist(), e.tolist(), strict=True):
                    out += words[at:x]
                    at = y
                left = b" ".join(out + words[at:])
                n.append(len(words))
                removed.append(int((e - b).sum()))
                sha.append(sha256_hex(left))
                if with_text:
                    kept.append(left.decode("utf-8", "replace"))
                    cut.append([{"begin": x, "end": y} for x, y in zip(b.tolist(), e.tolist(), strict=True)])
            columns, names = [batch.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)], ["key", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns += [pa.array(kept), pa.array(cut, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"key {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<begin: long, end: long>>" * with_text
    entries = spans.agg(F.sum(F.size("runs"))).first()[0] or 0
    return repeats.same_row(docs, spans, entries, "left").select("key", "text", "runs").mapInArrow(run, schema).withColumnRenamed("key", key)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(documents(spark, sf_dir), with_text=False)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT rid, b, md5(array_to_string(w[b : b + 34], ' ')) AS win FROM d, unnest(range(1, len(w) - 33)) AS u(b)),
r AS (SELECT rid, b FROM v WHERE win IN (SELECT win FROM v GROUP BY win HAVING count(*) > 1)),
x AS (SELECT DISTINCT rid, p FROM r, unnest(range(b, b + 35)) AS u(p)),
k AS (SELECT d.rid, string_agg(word, ' ' ORDER BY p) AS kept
      FROM (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) d ANTI JOIN x ON d.rid = x.rid AND d.p = x.p GROUP BY d.rid),
n AS (SELECT rid, count(*) AS n FROM x GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid) LEFT JOIN n USING (rid)
"""
