"""Quality classifier from weak labels.

Overlapping heuristic labellers vote bad, good or nothing on every text. The votes are counted by pattern over all rows
(at most 3 ** labellers patterns), and expectation-maximisation estimates each labeller's accuracy and the share of good
texts from the counts alone. The posterior of a pattern is the soft label of its texts. A bounded sample of rows (the
`sample` keys with the least hashes, one row each) with these labels trains a linear scorer over hashed features: word shapes and
bucketed statistics. The scorer rates every row.

Defined results: null and empty texts have no words; they are rated 0 and not kept; a table without rows gives an empty
result; rows with equal doc_id or text are rated alike; other columns are ignored. A text of any length counts whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, documents, durable, pieces
from gleaner.llm.op01_simhash import stretches

#: Rows that train the scorer, and its number of weights.
SAMPLE, SIZE = 6000, 1 << 16
KEEP = 0.5
GOOD, NONE, BAD = 2, 1, 0
#: Labellers: name, statistic, bad above or below, good above or below.
LABELLERS = (
    ("symbols", "symbols", 0.2, 0.02),
    ("capitals", "capitals", 0.6, 0.25),
    ("marks", "marks", 0.3, 0.1),
    ("bars", "bars", 0.15, 0.01),
    ("sameness", "sameness", 0.9, 0.75),
    ("repeats", "repeats", 0.2, 0.02),
    ("dup_lines", "dup_lines", 0.6, 0.3),
    ("brevity", "brevity", 0.05, 0.03),
    ("word_length", "odd_length", 4.0, 2.5),
)
STATISTICS = ("symbols", "capitals", "marks", "bars", "sameness", "repeats", "dup_lines", "brevity", "odd_length")
EDGES = np.array([0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.5, 2, 3, 4, 6])
_DROP = {name: bytes(sorted(chars)) for name, chars in {"symbols": b"#*$%&|<>", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "marks": b"!?"}.items()}
_RUNS = ((re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "0"))


@lru_cache(maxsize=300_000)
def _shape(word: bytes) -> int:
    """The weight of a word's shape: runs of letters and digits become one sign each."""
    s = word.decode("utf-8", "replace")
    for run, sign in _RUNS:
        s = run.sub(sign, s)
    return zlib.crc32(s.encode()) % SIZE


def measure(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Statistics, counts of shapes (two rows: weight, count) and the number of words of a text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = same = 0
    shapes: dict[int, int] = {}
    seen: set[bytes] = set()
    last = b""
    chars = 0
    for words in stretches(data):
        n += len(words)
        chars += sum(map(len, words))
        seen.update(words)
        same += sum(map(bytes.__eq__, words, [last, *words[:-1]]))
        last = words[-1] if words else last
        for s in map(_shape, words):
            shapes[s] = shapes.get(s, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda name: len(data) - len(data.translate(None, _DROP[name]))
    k, c = max(n, 1), max(chars, 1)
    stats = np.array(
        [
            count("symbols") / k,
            count("capitals") / c,
            count("marks") / k,
            data.count(b" | ") / k,
            1 - len(seen) / k if n >= 20 else 0.0,
            same / k,
            1 - len(set(lines)) / max(1, len(lines)),
            1 / k,
            abs(chars / k - 5.5),
        ]
    )
    pairs = np.array(sorted(shapes.items()), dtype=np.int64).reshape(-1, 2).T
    return stats, pairs, n


def vote(stats: np.ndarray) -> np.ndarray:
    """One vote of each labeller; stats is rows x statistics."""
    out = np.full((len(stats), len(LABELLERS)), NONE, dtype=np.int64)
    for j, (_, name, bad, good) in enumerate(LABELLERS):
        x = stats[:, STATISTICS.index(name)]
        out[x > bad] += np.eye(len(LABELLERS), dtype=np.int64)[j] * (BAD - NONE)
        out[x <= good] += np.eye(len(LABELLERS), dtype=np.int64)[j] * (GOOD - NONE)
    return out


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, P(vote | class) as classes x labellers x votes, share of good), by expectation-maximisation."""
    votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
    post = np.where((votes == BAD).any(axis=1), 0.1, 0.9)  # one bad vote makes a text suspect
    hits = np.stack([votes == v for v in range(3)], axis=2)
    prior, by = 0.9, np.zeros((2, labellers, 3))
    for _ in range(rounds):
        for k, w in enumerate((1 - post, post)):
            n = np.einsum("p,plv->lv", counts * w, hits) + 1.0
            by[k] = n / n.sum(axis=1, keepdims=True)
        prior = float(np.clip((counts * post).sum() / max(1, counts.sum()), 0.01, 0.99))
        log = [np.einsum("plv,lv->p", hits, np.log(by[k])) + np.log(p) for k, p in enumerate((1 - prior, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, by, prior


def _inputs(stats: np.ndarray, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and values of a text's hashed features."""
    at = [zlib.crc32(b"%d:%d" % (j, b)) % SIZE for j, b in enumerate(np.searchsorted(EDGES, stats).tolist())]
    return np.append(pairs[0], at).astype(np.int64), np.append(pairs[1] / max(1, n), np.ones(len(at)))


def train(inputs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer for soft labels; the classes weigh alike."""
    if not inputs:
        return np.zeros(SIZE)
    at, value = np.concatenate([x[0] for x in inputs]), np.concatenate([x[1] for x in inputs])
    row = np.repeat(np.arange(len(inputs)), [len(x[0]) for x in inputs])
    each = np.where(labels > 0.5, 0.5 / max(1, (labels > 0.5).sum()), 0.5 / max(1, (labels <= 0.5).sum()))
    w, square = np.zeros(SIZE), np.full(SIZE, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[at], minlength=len(inputs)), -30, 30)))
        g = np.bincount(at, value * (each * (p - labels))[row], minlength=SIZE) + decay * w
        square += g * g
        w -= rate * g / np.sqrt(square)
    return w


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Per row: key, quality_score (0 to 1), kept, weak_score (the posterior of its votes), n_words."""
    bounded_batches(df.sparkSession)
    base = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b)):
            got = [measure(x) for x in batch.column("text").to_pylist()]
            found, n = np.unique(pattern(vote(np.array([x[0] for x in got])))[np.array([x[2] > 0 for x in got])], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pattern", "n"])

    counted = base.select("text").mapInArrow(votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns, counts = (np.array([r[i] for r in counted], dtype=np.int64) for i in range(2))
    soft = dict(zip(patterns.tolist(), estimate(patterns, counts)[0].tolist(), strict=True)) if len(patterns) else {}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in map(measure, b.column("text").to_pylist()) if x[2]]
        labels = np.array([soft[p] for p in pattern(vote(np.array([x[0] for x in got]))).tolist()]) if got else np.zeros(0)
        w = train([_inputs(*x) for x in got], labels)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    chosen = durable(base.select("key").filter("key IS NOT NULL").distinct().orderBy(F.xxhash64("key"), "key").limit(sample))
    # At most `sample` keys are broadcast, and their texts train in one task.
    picked = base.join(F.broadcast(chosen), "key").groupBy("key").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))  # one row a key
    weights = picked.select("x.text").repartition(1).mapInArrow(fit, "at long, w double").collect()
    w = np.zeros(SIZE)
    for r in weights:
        w[r.at] = r.w
    sent = df.sparkSession.sparkContext.broadcast((w, soft))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, soft = sent.value
        for batch in (p for b in batches for p in pieces(b)):
            got = [measure(x) for x in batch.column("text").to_pylist()]
            weak = [soft.get(p, 0.5) if x[2] else 0.0 for p, x in zip(pattern(vote(np.array([x[0] for x in got]))).tolist(), got, strict=True)]
            sums = [float(w[a] @ v) for a, v in (_inputs(*x) for x in got)]
            rated = [1 / (1 + float(np.exp(-np.clip(s, -30, 30)))) if x[2] else 0.0 for s, x in zip(sums, got, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(rated), pa.array([r >= keep for r in rated]), pa.array(weak, pa.float64()), pa.array([x[2] for x in got], pa.int64())],
                ["key", "quality_score", "kept", "weak_score", "n_words"],
            )

    return base.mapInArrow(score, f"key {kind}, quality_score double, kept boolean, weak_score double, n_words long").withColumnRenamed("key", key)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
