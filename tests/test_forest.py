"""Forests on cells: against Spark ML in distribution, brute force for the parts, one job for all fits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import forest, model, scores, timeline
from gleaner.plans import queries, stages


def _rows(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.normal(size=n), rng.integers(0, 5, n).astype(float)], axis=1)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.7 * rng.normal(size=n) > 0.5).astype(np.uint8)
    return x, y


def _cells(x, y):
    weight = (len(y) / (2 * np.bincount(y)))[y]
    thresholds = [forest.splits(x[:, f], weight) for f in range(x.shape[1])]
    return thresholds, forest.cells(forest.binned(x, thresholds), y)


def test_splits_and_cells():
    few = np.array([3.0, 1.0, 1.0, 2.0])
    assert forest.splits(few, np.ones(4)).tolist() == [1.5, 2.5] and forest.splits(np.ones(5), np.ones(5)).tolist() == []
    many = forest.splits(np.arange(1000.0), np.ones(1000))
    assert len(many) == forest.BINS - 1 and np.abs(np.diff(many) - 1000 / forest.BINS).max() <= 1
    near = np.nextafter(1.0, 2.0)
    assert forest.binned(np.array([[1.0], [near]]), [forest.splits(np.array([1.0, near]), np.ones(2))]).tolist() == [[0], [1]]
    codes = np.random.default_rng(1).integers(0, 2, (500, 30)).astype(np.uint8)  # more than a key has room for
    codes[250:] = codes[:250]
    y = (np.arange(500) % 250 % 2).astype(np.uint8)
    c, of, n = forest.cells(codes, y)
    want = {}
    for r, k in zip(codes.tolist(), y.tolist(), strict=True):
        want[*r, k] = want.get((*r, k), 0) + 1
    assert {(*r, k): m for r, k, m in zip(c.tolist(), of.tolist(), n.tolist(), strict=True)} == want


def test_best_split_by_brute_force():
    rng = np.random.default_rng(8)
    codes, y, n = rng.integers(0, 6, (40, 3)).astype(np.uint8), rng.integers(0, 2, 40), rng.integers(1, 4, 40)
    per, raw, leaf = np.array([0.8, 1.3]), np.bincount(y, n, 2)[None, :], 4
    gini = lambda k: 1 - (((k * per) / (k * per).sum()) ** 2).sum()
    want = 0.0
    for f in range(3):
        for b in range(5):
            a = np.bincount(y[codes[:, f] <= b], n[codes[:, f] <= b], 2)
            if min(a.sum(), (raw[0] - a).sum()) >= leaf:
                share = (a * per).sum() / (raw[0] * per).sum()
                want = max(want, gini(raw[0]) - share * gini(a) - (1 - share) * gini(raw[0] - a))
    gain, f, b, left = forest._best(codes, y, np.zeros(40, int), np.arange(40), n, np.arange(3)[None, :], raw, per, leaf, 6)
    own = codes[:, f[0]] <= b[0]
    assert gain[0] == pytest.approx(want) and left[0].tolist() == np.bincount(y[own], n[own], 2).tolist()


def test_first_trees_are_the_smaller_forest(monkeypatch):
    x, y = _rows(300)
    _, (codes, of, n) = _cells(x, y)
    whole = forest.grown(codes, of, n, codes, 2, [1, 5], [10, 25], 9)
    monkeypatch.setattr(forest, "BATCH", 700)  # a few trees a batch
    for leaf in (1, 5):
        small = forest.grown(codes, of, n, codes, 2, [leaf], [10], 9)[leaf, 10]
        assert np.allclose(whole[leaf, 10][0], small[0]) and np.allclose(whole[leaf, 10][1], small[1])
    assert not np.allclose(whole[1, 25][0], whole[5, 25][0]) and whole[1, 25][1].sum() == pytest.approx(1)


def test_bags_have_as_many_rows_either_way():
    few, many = np.array([1, 2, 1]), np.array([100, 300, 50])
    for count in (few, many):
        tree, cell, drawn, keys = forest._bags(count, 4, range(400))
        assert np.bincount(tree, drawn).tolist() == [count.sum()] * 400 and len(set(keys.tolist())) == 400
        assert np.bincount(cell, drawn) / drawn.sum() == pytest.approx(count / count.sum(), abs=0.05)
    y = np.array([0, 1, 1])
    again = forest.resampled(y, many, 5)
    assert np.bincount(y, again).tolist() == np.bincount(y, many).tolist() and (again != many).any()


def test_trees_without_a_split():
    one = np.zeros((3, 2), np.uint8)
    chance, gain = forest.grown(one, np.array([0, 1, 1]), np.array([2, 1, 1]), one[:1], 1, [1], [50], 1)[1, 50]
    assert gain.tolist() == [0, 0] and 0 < chance[0] < 1
    chance, _ = forest.grown(one, np.array([1, 1, 1]), np.array([2, 1, 1]), one[:1], 1, [1], [3], 1)[1, 3]
    assert chance.tolist() == [1]


def test_outcome_as_the_scores_have_it(spark):
    rng = np.random.default_rng(2)
    y, chance, n = rng.integers(0, 2, 30), rng.integers(0, 6, 30) / 6, rng.integers(1, 4, 30)
    rows = [(0, int(a), float(c), int(c > 0.5)) for a, c, k in zip(y, chance, n, strict=True) for _ in range(k)]
    df = spark.createDataFrame(rows, "k int, y int, x double, p int")
    want = scores.confusion(df, ["k"]).join(scores.auc(df, ["k"]), "k").first()
    *counts, auc = forest.outcome(y, chance, n)
    assert tuple(counts) == (want.tn, want.fp, want.fn, want.tp) and auc == pytest.approx(want.auc)
    assert forest.outcome(y * 0, chance, n)[-1] is None


def test_agrees_with_spark_ml(spark):
    """Importances and probabilities of two libraries' forests of equal parameters. Spark's classifier merges leaves that predict
    one class, which blunts probabilities; its regression of 0 and 1 has the same splits and keeps them."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    x, y = _rows(900)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], "a double, b double, c double, label int")
    weight = F.when(F.col("label") == 1, len(y) / (2 * int(y.sum()))).otherwise(len(y) / (2 * int((1 - y).sum())))
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).withColumn("weight", weight).coalesce(1)
    rf = RandomForestRegressor(weightCol="weight", numTrees=100, featureSubsetStrategy="sqrt", minInstancesPerNode=5, maxDepth=6, seed=5).fit(df)
    theirs = np.array([r.prediction for r in rf.transform(df).select("prediction").collect()])
    thresholds, (codes, of, n) = _cells(x, y)
    chance, gain = forest.grown(codes, of, n, forest.binned(x, thresholds), model.tries("sqrt", 3), [5], [100], 5, depth=6)[5, 100]
    assert gain == pytest.approx(rf.featureImportances.toArray(), abs=0.03)
    assert np.abs(chance - theirs).mean() < 0.025 and abs((chance - theirs).mean()) < 0.01  # 0.016 between seeds of either


def test_numbers_of_features():
    assert [model.tries(f, 3) for f in ("sqrt", "log2", "0.3", "0.5")] == [2, 2, 1, 2] and model.tries("log2", 1) == 1
    assert [model.tries(f, 58) for f in ("sqrt", "log2", "0.3", "0.5")] == [8, 6, 18, 29]


def test_tuning_is_one_job_and_picks_the_best(spark, monkeypatch):
    """Every point of every fold is scored, by one call of fit for all windows; a fold with one class gives the first point."""
    x, y = _rows(400)
    rows = [("d", i, i, int(y[i]), *map(float, x[i])) for i in range(400)] + [("e", i, i, int(i > 170 and i % 2), 0.0, 1.0, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "dataset string, commit_id long, date long, label int, a double, b double, c double")
    cells, _, wins = stages._modelled(df, ["a", "b", "c"])
    calls, fit = [], model.fit
    monkeypatch.setattr(model, "fit", lambda c, wanted: calls.append(wanted) or fit(c, wanted))
    points = [{"trees": t, "features": f, "leaf": k} for t in (3, 6) for f in ("0.3", "sqrt", "0.5") for k in (1, 40)]
    picked = model.tune(cells, wins, [7] * len(wins), points, 3)
    assert len(calls) == 1 and {w.dataset for w in wins} == {"d", "e"}
    for w, pick in zip(wins, picked, strict=True):
        folds = cells.filter((F.col("dataset") == w.dataset) & (F.col("window_id") == w.window_id) & (F.col("fold") > 0)).collect()
        assert len(folds) == 3
        if min(r.classes for r in folds) < 2:
            assert w.dataset == "e" and pick == points[0]
            continue
        means = []
        for p in points:
            wanted = [(w.dataset, w.window_id, r.fold, 0, False, model.tries(p["features"], 3), [p["leaf"]], [p["trees"]], 7) for r in folds]
            means.append(np.mean([r.gmean for r in model.evaluate(fit(cells, wanted))]))
        assert pick == points[int(np.argmax(np.round(means, 12)))]


def test_unfit_rows_are_an_error(spark):
    rows = [("d", i, i, i % 2, float(i)) for i in range(90)]
    schema = "dataset string, commit_id long, date long, label int, a double"
    for bad in (("d", 5, 5, 1, None), ("d", 5, 5, 1, float("nan")), ("d", 5, 5, None, 1.0), ("d", 5, 5, 2, 1.0)):
        df = spark.createDataFrame([*rows[:5], bad, *rows[6:]], schema)
        numbered = model.assembled(timeline.numbered(df), ["a"])
        wins = timeline.windows(timeline.numbered(df)).collect()
        with pytest.raises(Exception):  # noqa: B017
            model.sliced(numbered, wins).collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_stage_ends(spark):
    """25 windows, the full grid and 20 bootstraps; it ran for over an hour with one Spark ML fit after another."""
    got = queries.rf_mdi(spark, "/root/testdata/sf0.001")
    total = got.groupBy("dataset", "window_id", "bootstrap_id").agg(F.sum("importance").alias("s"), F.count("concept").alias("n")).collect()
    assert len(total) == 5 * 5 * 20 and all(r.s == pytest.approx(1) and r.n == 3 for r in total)
