"""Random forests over time-forward windows: tuning, bootstrap, importances, evaluation.

A dataset's windows are binned in one task and kept as cells (see forest); every fit is a task of one Spark job. Class weights
are n / (2 * n_c) of a fit's rows; trees are at most 10 deep and splits are binned, so values differ from exact, per-bootstrap
balanced forests while distributions agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from gleaner.operators import forest, scores

#: The tuning grid; its first entries are the defaults.
GRID = {"trees": (100, 200, 300), "features": ("sqrt", "log2", "0.3", "0.5"), "leaf": (1, 3, 5)}
METRICS = ("gmean", "balanced_accuracy", "f1", "mcc", "pd", "pf", "recall0", "recall1", "auc")
_CELLS = ("codes", "y", "n", "seen_codes", "seen_y", "seen_n")
_KINDS = (np.uint8, np.uint8, np.int64) * 2
_RESULT = "dataset string, window_id long, fold int, repeat int, tries int, leaf int, trees int, importance array<double>, tn long, fp long, fn long, tp long, auc double"


def grid(small: bool = False) -> list[dict]:
    points = [dict(zip(GRID, x, strict=True)) for x in product(*GRID.values())]
    return points[:1] if small else points


def tries(features: str, width: int) -> int:
    """How many of `width` features a node tries."""
    n = {"sqrt": math.sqrt(width), "log2": math.log2(width)}[features] if features in ("sqrt", "log2") else float(features) * width
    return max(1, math.ceil(n))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds features, an array of doubles; nulls are an error."""
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(df)
    return vectors.withColumn("features", vector_to_array("features"))


def forward_folds(n: int, most: int = 3) -> list[tuple[int, int, int]]:
    """(training end, test begin, test end): each test slice follows all rows that train."""
    folds = min(most, max(2, n // 50))
    size = n // (folds + 1)
    return [(n - (folds - i) * size, n - (folds - i) * size, n - (folds - i - 1) * size) for i in range(folds)] if size else []


def _slice(x: np.ndarray, y: np.ndarray, train: slice, test: slice) -> dict:
    """Cells of both slices, binned by what trains."""
    known, of = x[train], y[train]
    size = np.bincount(of, minlength=2)
    weight = (len(of) / (2 * np.maximum(size, 1)))[of]
    thresholds = [forest.splits(known[:, f], weight) for f in range(x.shape[1])]
    parts = (*forest.cells(forest.binned(known, thresholds), of), *forest.cells(forest.binned(x[test], thresholds), y[test]))
    return {"classes": int((size > 0).sum())} | {c: np.ascontiguousarray(p, k).tobytes() for c, p, k in zip(_CELLS, parts, _KINDS, strict=True)}


def sliced(numbered: DataFrame, wins: list[Row]) -> DataFrame:
    """(dataset, window_id, fold, width, classes, cells): fold 0 is a window, the others are the forward folds of its training
    slice. A dataset's features fit one task; rows have dataset, idx, label and features."""
    plan: dict[str, list[tuple]] = {}
    for w in wins:
        plan.setdefault(w.dataset, []).append((w.window_id, w.train_start, w.train_end + 1, w.test_start, w.test_end + 1))
    schema = "dataset string, window_id long, fold int, width int, classes int, " + ", ".join(f"{c} binary" for c in _CELLS)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("idx").to_numpy(), kind="stable")
        y = rows.column("label").to_numpy()[order]
        if not np.isin(y, (0, 1)).all():
            raise ValueError("labels are 0 or 1")
        y, x = y.astype(np.uint8), np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column("features").chunks]).reshape(len(y), -1)[order]
        out = []
        for window, begin, end, test, stop in plan.get(key[0].as_py(), ()):
            parts = [(end, test, stop), *[tuple(begin + p for p in fold) for fold in forward_folds(end - begin)]]
            for fold, (e, a, b) in enumerate(parts):
                out.append({"dataset": key[0].as_py(), "window_id": window, "fold": fold, "width": x.shape[1]} | _slice(x, y, slice(begin, e), slice(a, b)))
        return pa.Table.from_pylist(out, _arrow(schema))

    return numbered.select("dataset", "idx", F.col("label").cast("int").alias("label"), "features").groupBy("dataset").applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def fit(cells: DataFrame, wanted: list[tuple], depth: int = 10) -> DataFrame:
    """One row of importances, confusion counts and auc for each wanted fit, leaf and number of trees. wanted: (dataset, window_id,
    fold, repeat, resample, tries, leaves, numbers of trees, seed); resample draws as many rows of each class with replacement."""
    fits = cells.sparkSession.createDataFrame(wanted, "dataset string, window_id long, fold int, repeat int, resample boolean, tries int, leaves array<int>, trees array<int>, seed long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist()):
                codes, y, n, seen, seen_y, seen_n = (np.frombuffer(r[c], k) for c, k in zip(_CELLS, _KINDS, strict=True))
                codes, seen = codes.reshape(-1, r["width"]), seen.reshape(-1, r["width"])
                count = forest.resampled(y, n, r["seed"]) if r["resample"] else n
                rows = []
                for (leaf, trees), (chance, importance) in forest.grown(codes, y, count, seen, r["tries"], r["leaves"], r["trees"], r["seed"], depth).items():
                    scored = dict(zip(("tn", "fp", "fn", "tp", "auc"), forest.outcome(seen_y, chance, seen_n), strict=True))
                    rows.append({c: r[c] for c in ("dataset", "window_id", "fold", "repeat", "tries")} | {"leaf": leaf, "trees": trees, "importance": importance.tolist()} | scored)
                yield pa.RecordBatch.from_pylist(rows, _arrow(_RESULT))

    keyed = cells.join(F.broadcast(fits), ["dataset", "window_id", "fold"])
    tasks = min(len(wanted), 8 * cells.sparkSession.sparkContext.defaultParallelism)  # large and small fits mixed
    return keyed.repartition(max(1, tasks)).mapInArrow(run, _RESULT)


def evaluate(fitted: DataFrame) -> list[Row]:
    """Rows with METRICS by window and repeat, a few hundred; auc is null with one class. A sort in Spark would fit twice, once to sample."""
    return sorted(scores.classifier_metrics(fitted).collect(), key=lambda r: (r.dataset, r.window_id, r.fold, r.repeat))


def tune(cells: DataFrame, wins: list[Row], seeds: list[int], points: list[dict], width: int) -> list[dict]:
    """For each window the point with the best mean G-mean over forward folds (the first on a tie); a fold with one class, or a
    single point, gives the first. Points that try equally many features share a fit, and those with fewer trees a forest's first."""
    if len(points) == 1:
        return [points[0]] * len(wins)
    folds: dict[tuple, list] = {}
    for r in cells.filter("fold > 0").select("dataset", "window_id", "fold", "classes").collect():  # three rows a window
        folds.setdefault((r.dataset, r.window_id), []).append(r)
    sizes: dict[tuple[int, int], set[int]] = {}
    for p in points:
        sizes.setdefault((tries(p["features"], width), p["leaf"]), set()).add(p["trees"])
    shared: dict[tuple, list[int]] = {}
    for (n, leaf), t in sizes.items():
        shared.setdefault((n, *sorted(t)), []).append(leaf)
    wanted = []
    for w, seed in zip(wins, seeds, strict=True):
        own = folds.get((w.dataset, w.window_id), [])
        if all(r.classes == 2 for r in own):
            wanted += [(w.dataset, w.window_id, r.fold, 0, False, n, leaves, t, seed) for r in own for (n, *t), leaves in shared.items()]
    if not wanted:
        return [points[0]] * len(wins)
    got: dict[tuple, list[tuple]] = {}
    for r in evaluate(fit(cells, wanted)):
        got.setdefault((r.dataset, r.window_id, r.tries, r.leaf, r.trees), []).append(r.gmean)
    picked = []
    for w in wins:
        best, pick = -1.0, points[0]
        for p in points:
            by_fold = got.get((w.dataset, w.window_id, tries(p["features"], width), p["leaf"], p["trees"]), ())
            if by_fold and sum(by_fold) / len(by_fold) > best:
                best, pick = sum(by_fold) / len(by_fold), p
        picked.append(pick)
    return picked


def bootstrap(df: DataFrame, seed: int, label: str = "label", order: str = "idx") -> DataFrame:
    """Exactly as many rows of each class as df has, drawn with replacement: draws are row numbers, joined by class and number."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(label).orderBy(order)) - 1)
    size = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col("_n")), F.col("_size")).cast("int")
    drawn = numbered.select(label, "_n").join(F.broadcast(size), label).select(label, draw.alias("_n"))  # a row per class
    return drawn.join(numbered, [label, "_n"]).drop("_n")
