"""Candidates for repeated windows: super-k-mers.

A window is `width` consecutive symbols of a text. Each window's anchor is the least hash of its grams of `gram` symbols,
the leftmost of equal ones, so equal windows have equal anchors wherever they stand. Consecutive windows with their anchor
at one place form a piece (a super-k-mer): one row instead of one per window. Windows of one piece differ. An anchor that occurs once has no repeated window. An anchor whose pieces are all
equal repeats whole, or not at all. Only anchors with different pieces ("branching") need a closer look at their windows.

Symbols are two rows of 64-bit codes that don't depend on each other. Hashes are polynomials modulo 2**64, the first over the
first codes and the second, with another multiplier, over the second. Windows are equal if both hashes are; pieces are
equal if the first hash of their anchors and the second of all their symbols are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, checkpoint_folder, pieces, row_key

#: Windows handled at once; pieces end there, which costs a closer look but changes no result.
STRETCH = 1 << 17
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Bits of a gram's place in a stretch.
_PLACE = np.uint64((1 << 18) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a multiplier and of its inverse, grown on demand."""

    def __init__(self, multiplier: int):
        self.by = (multiplier, pow(multiplier, -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([t, t * np.uint64(pow(m, k, 1 << 64))]) for t, m in zip((self.up, self.down), self.by, strict=True))
        return self.up[:n], self.down[:n]


_POWERS = tuple(map(_Powers, _MULTIPLIERS))


class Rolling:
    """Hashes of any stretch of symbols."""

    def __init__(self, symbols: np.ndarray, which: int):
        up, self.down = _POWERS[which].upto(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def of(self, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[begin + size] - self.sums[begin]) * self.down[begin])

    def each(self, size: int) -> np.ndarray:
        """Of every stretch of `size` symbols."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def least_of_each(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span :][: len(x) - width + 1]) if span < width else out


def find_pieces(symbols: np.ndarray, ends: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, digest, text, first window in it, number of windows, times) of the pieces of texts that stand one after another and end at `ends`.

    No text is shorter than `width`. Equal pieces one after another, as periodic text has them, are one with `times`.
    """
    out: list[tuple] = []
    # Windows that cross the end of a text lie between those of two texts and are left out.
    within = np.ones(max(symbols.shape[1] - width + 1, 0), dtype=bool)
    for k in range(1, width):
        within[ends[:-1] - k] = False
    for a in range(0, len(within), STRETCH):
        part = symbols[:, a : a + STRETCH + width - 1]
        hashes = Rolling(part[0], 0).each(gram)
        # The least hash by its upper bits, and of equal ones the leftmost: its place is in the lower bits.
        least = least_of_each((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), width - gram + 1)
        inside = within[a : a + len(least)]
        begin = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])))
        count = np.diff(np.append(begin, len(least)))
        begin, count = begin[inside[begin]], count[inside[begin]]
        out.append((hashes[(least[begin] & _PLACE).astype(np.int64)], Rolling(part[1], 1).of(begin, count + (width - 1)), begin + a, count))
    if not out:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    a, d, p, n = (np.concatenate(x) for x in zip(*out, strict=True))
    text = np.searchsorted(ends, p, side="right")
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (n[1:] != n[:-1]) | (p[1:] != p[:-1] + n[:-1])))
    return a[head], d[head], text[head], (p - np.append(0, ends)[text])[head], n[head], np.diff(np.append(head, len(a)))


def window_hashes(symbols: np.ndarray, begin: int, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each of `count` windows from `begin` on."""
    part = symbols[:, begin : begin + count + width - 1]
    return Rolling(part[0], 0).each(width), Rolling(part[1], 1).each(width)


def covered(begin: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted spans (begin, end) that runs of `count` windows from `begin` on cover."""
    if not len(begin):
        return begin, begin
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], np.maximum.accumulate((begin + count + width - 1)[order])
    new = np.append(True, b[1:] > e[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)
    return b[new], e[last]


def lists(column: pa.ListArray, *fields: str) -> list[tuple[np.ndarray, ...]]:
    """Each row's list of structs (or of plain values, without fields) as numpy arrays; a null row has empty ones."""
    flat = column.flatten()
    arrays = [flat.field(f).to_numpy(zero_copy_only=False) for f in fields] if fields else [flat.to_numpy(zero_copy_only=False)]
    ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [tuple(a[x:y] for a in arrays) for x, y in zip([0, *ends], ends, strict=False)]


class Scratch:
    """Tables in the shared folder for intermediate results, to be dropped when they have served."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        checkpoint_folder(bounded_batches(spark))
        self.root = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Texts of a batch that have a window, by their place, with their symbols.
Reader = Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), row_key(F.col(key), F.col(text)).alias("rid"), F.col(text).alias("text"))


def _groups(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Texts of one stretch together, so that only a text longer than that is cut, wherever it stands."""
    group, size = [], 0
    for i, symbols in texts:
        if group and size + symbols.shape[1] > STRETCH:
            yield group
            group, size = [], 0
        group.append((i, symbols))
        size += symbols.shape[1]
    if group:
        yield group


def occurrences(docs: DataFrame, read: Reader, width: int, gram: int) -> DataFrame:
    """(anchor, digest, key, rid, pos, n, times): the pieces of keyed documents."""
    kind = docs.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            found = []
            for group in _groups(read(batch)):
                a, d, text, p, n, times = find_pieces(np.concatenate([x for _, x in group], axis=1), np.cumsum([x.shape[1] for _, x in group]), width, gram)
                found.append((a, d, np.array([i for i, _ in group])[text], p, n, times))
            if not found:
                continue
            a, d, row, p, n, times = (np.concatenate(x) for x in zip(*found, strict=True))
            row = pa.array(row)
            numbers = [pa.array(x.astype(np.int32)) for x in (p, n, times)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(d.view(np.int64)), batch.column("key").take(row), batch.column("rid").take(row), *numbers], ["anchor", "digest", "key", "rid", "pos", "n", "times"]
            )

    return docs.select("key", "rid", "text").mapInArrow(run, f"anchor long, digest long, key {kind}, rid long, pos int, n int, times int")


def repeated_anchors(pieces: DataFrame) -> DataFrame:
    """(anchor, n_pieces, branches) of anchors with two pieces or more; branches: not all of them are equal."""
    agg = pieces.groupBy("anchor").agg(F.sum("times").alias("n_pieces"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return agg.filter("n_pieces > 1").select("anchor", "n_pieces", (F.col("low") != F.col("high")).alias("branches"))


#: Entries of a partition's hash table up to which a join by row is hashed; beyond, it is sorted, which can spill.
HASHED = 1_000_000


def same_row(a: DataFrame, b: DataFrame, entries: int, how: str = "inner") -> DataFrame:
    """Joins on rid and key; b's columns are called other_rid and other_key and go. b has a row per document and `entries` list entries in all."""
    b = b.withColumnsRenamed({"rid": "other_rid", "key": "other_key"})
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    b = b.hint("shuffle_hash") if entries <= HASHED * parts else b
    return a.join(b, (a.rid == b.other_rid) & a.key.eqNullSafe(b.other_key), how).drop("other_rid", "other_key")
