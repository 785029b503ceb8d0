"""Unit tests over small worked cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.operators import affected, calls, diff, metrics, model, ranking, rollup, scores, tables, timeline
from gleaner.plans import stages

DIFF = "--- a/f\n+++ b/f\n@@ -1 +1,2 @@\n-old\n+new\n+++two\n@@ -10,0 +12,2 @@ f\n+x\n\\ No newline\n+y\n@@ -20,3 +24,0 @@\n-gone"


def test_diff(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, "no hunk\n+x")], "id int, diff string")
    got = {r.id: ([tuple(x) for x in r.added], [tuple(x) for x in r.deleted]) for r in diff.parse_unified(df).collect()}
    assert got[1] == ([(1, "new"), (12, "x"), (14, "y")], [(1, "old"), (20, "gone")]) and got[2] == got[3] == ([], [])
    lines = {(r.id, r.line) for r in diff.hunk_lines(df, ["id"]).collect()}
    assert lines == {(1, 1), (1, 2), (1, 12), (1, 13)}
    assert {r.line for r in diff.hunk_lines(df, ["id"], side="old").collect()} == {1, 20, 21, 22}


def test_range_join_is_exact(spark):
    rng = random.Random(4)
    ms = [(f"f{rng.randrange(3)}", i, s, s + rng.randrange(0, 200)) for i, s in ((i, rng.randrange(400)) for i in range(60))]
    ls = sorted({(f"f{rng.randrange(3)}", rng.randrange(700)) for _ in range(40)})
    got = diff.methods_on_lines(spark.createDataFrame(ms, "file string, method int, start int, end int"), spark.createDataFrame(ls, "file string, line int"))
    assert {r.method for r in got.collect()} == {m for f, m, s, e in ms if any(g == f and s <= x <= e for g, x in ls)}


def test_names(spark):
    row = spark.range(1).select(
        P.language_of(F.lit("a/b.sh"), ["shell", "bash"]).alias("a"),
        P.language_of(F.lit("CMakeLists.txt"), ["python", "cmake"]).alias("b"),
        P.class_hint(F.lit("ns::Widget::draw(int)"), F.lit("draw")).alias("c"),
        P.symbol_tail(F.lit(r"a\b\C")).alias("d"),
        P.module_and_symbol(F.lit("x.y.Z"))[0].alias("e"),
        P.python_module(F.lit("pkg/sub/__init__.py")).alias("f"),
        P.concept_of(F.lit("current_new_file_count")).alias("g"),
        P.token_count(F.lit(" a  b\n")).alias("h"),
        P.normal_seed(F.lit(4294967296)).alias("i"),
    ).first()
    assert tuple(row) == ("shell", "cmake", "Widget", "C", "x.y", "pkg.sub", "current_new_file_count", 2, 1)


def test_rollup_statistics(spark):
    df = spark.createDataFrame([("a", "m1", 1.0), ("a", "m2", None), ("a", "m3", 3.0), ("b", "m1", 2.0), ("c", "m1", None)], "commit_id string, method_id string, cc double")
    got = {r.commit_id: tuple(r)[1:] for r in rollup.complete(rollup.commit_rollup(df, ["cc"])).collect()}
    assert got["a"] == (2.0, 3.0, 1.0, 1.0, 3, True, True) and got["b"][3] == 0.0 and got["c"][:4] == (None,) * 4 and got["c"][-1] is False


def test_degrees(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "b"), ("b", "a")], "caller string, callee string")
    got = {r.node: (r.in_coupling, r.out_coupling) for r in calls.degrees(nodes, edges).collect()}
    assert got == {"a": (2, 2), "b": (1, 1), "c": (0, 0)} and sum(x for x, _ in got.values()) == sum(x for _, x in got.values())


def test_cascade_tiers(spark):
    m = spark.createDataFrame(
        [("m1", "a.py", "A", "run", 1, "python"), ("m2", "a.py", "", "run", 9, "python"), ("m3", "p/b.py", "B", "go", 1, "python"), ("m4", "p/b.py", "", "fn", 5, "python"), ("m5", "q.py", "", "only", 1, "python"), ("m6", "x.py", "", "twice", 1, "python"), ("m7", "y.py", "", "twice", 1, "python")],
        "method string, file string, cls string, name string, start int, language string",
    )
    none = (None, None, None)
    sites = [(1, "a.py", "A", 3, "python", "run", *none), (2, "a.py", "", 8, "python", "run", *none), (3, "a.py", "", 1, "python", "go", None, "x.B", None), (4, "a.py", "", 1, "python", "fn", "b", None, "b.fn"), (5, "a.py", "", 1, "python", "f2", None, None, None), (6, "a.py", "", 1, "python", "only", *none), (7, "a.py", "", 1, "python", "twice", *none), (8, "a.py", "", 1, "python", "go", "bee", None, None)]
    s = spark.createDataFrame(sites, "site int, file string, cls string, start int, language string, callee string, receiver string, inferred string, dotted string")
    imports = spark.createDataFrame([("a.py", "b", "p.b"), ("a.py", "f2", "p.b.fn"), ("a.py", "bee", "p.b.B")], "file string, alias string, target string")
    got = {r.site: (r.tier, r.callee) for r in calls.resolve_callees(s, m, imports).collect()}
    assert got[1] == (1, "m1") and got[2] == (2, "m2") and got[3] == (3, "m3") and got[4] == (8, "m4") and got[5] == (9, "m4") and got[6] == (11, "m5") and 7 not in got and got[8] == (4, "m3")


def test_candidates(spark):
    cols = "file string, name string, start int, end int"
    m = spark.createDataFrame([("f", "a", 1, 2), ("f", "b", 3, 4), ("g", "a", 1, 2)], cols)
    none = m.limit(0)
    files = spark.createDataFrame([("f", True), ("g", False)], "file string, added boolean")
    got = {(r.file, r.name): r.reason for r in affected.select_candidates(files, m, m.filter("file = 'g'"), m.filter("file = 'g'")).collect()}
    assert got == {("f", "a"): "current_added_file_all_methods", ("f", "b"): "current_added_file_all_methods", ("g", "a"): "strict_union_changed_methods"}
    assert affected.select_candidates(files.filter("NOT added"), none, none, none).count() == 0


def _samples(seed, n=300):
    rng = random.Random(seed)
    return [("d", rng.randrange(12) / 2.0, int(rng.random() < 0.4)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_rank_scores(spark, seed):
    rows = _samples(seed)
    df = spark.createDataFrame(rows, "dataset string, x double, y int")
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert scores.spearman(df, ["dataset"], absolute=False).first().score == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1], abs=1e-12)
    s = sum(np.sign(a - b) * np.sign(c - d) for (a, c), (b, d) in itertools.combinations(zip(x, y, strict=True), 2))
    ties = lambda v: sum(a == b for a, b in itertools.combinations(v, 2))
    pairs = len(x) * (len(x) - 1) / 2
    assert scores.kendall(df, ["dataset"], absolute=False).first().score == pytest.approx(s / np.sqrt((pairs - ties(x)) * (pairs - ties(y))), abs=1e-12)
    area = np.mean([(a > b) + (a == b) / 2 for a in x[y == 1] for b in x[y == 0]])
    assert scores.auc(df, ["dataset"]).first().auc == pytest.approx(area, abs=1e-12)


def test_degenerate_scores(spark):
    df = spark.createDataFrame([("one", 1.0, 1), ("const", 2.0, 0), ("const", 2.0, 1), ("const", 2.0, 1), ("single", 1.0, 1), ("single", 2.0, 1), ("single", 3.0, 1)], "dataset string, x double, y int")
    for f in (scores.spearman, scores.kendall, scores.mutual_information):
        assert {r.score for r in f(df, ["dataset"]).collect()} == {0.0}


def test_mutual_information(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    rows = [("near", float(a + 0.1 * b), int(a)) for a, b in zip(y, rng.standard_normal(2000), strict=True)] + [("far", float(b), int(a)) for a, b in zip(y, rng.standard_normal(2000), strict=True)]
    got = {r.dataset: r.score for r in scores.mutual_information(spark.createDataFrame(rows, "dataset string, x double, y int"), ["dataset"]).collect()}
    assert got["near"] == pytest.approx(np.log(2), abs=0.05) and got["far"] < 0.05


def test_classifier_metrics(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("a", 1, 0), ("a", 0, 1), ("b", 1, 1)], "k string, y int, p int")
    got = {r.k: r for r in scores.classifier_metrics(scores.confusion(df, ["k"])).collect()}
    assert got["a"].gmean == pytest.approx(0.5) and got["a"].mcc == 0 and got["b"].recall0 == 0 and got["b"].f1 == 1


@pytest.mark.parametrize(("n", "count"), [(69, 0), (70, 1), (100, 4), (200, 5), (1000, 5)])
def test_window_counts(spark, n, count):
    df = spark.range(n).select(F.lit("d").alias("dataset"), F.col("id").alias("commit_id"), F.col("id").alias("date"), (F.col("id") % 2).alias("label"))
    wins = timeline.windows(df).collect()
    assert len(wins) == count and all(w.train_end + 1 == w.test_start and w.test_end < n for w in wins)


def test_rank_groups(spark):
    r = spark.createDataFrame([(f"f{i}", i // 2 + 1) for i in range(14)], "feature string, rank int")
    got = {k.topk_percent: (k.g, k.n) for k in ranking.top_groups(r, [10, 50, 100]).groupBy("topk_percent").agg(F.max("selected_rank_group_count").alias("g"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == {10: (1, 2), 50: (4, 8), 100: (7, 14)}


def test_cluster_ranks():
    rng = np.random.default_rng(0)
    ranks = ranking.cluster_ranks({"a": rng.normal(10, 1, 80), "b": rng.normal(10, 1, 80), "c": rng.normal(2, 1, 80)})
    assert ranks == {"a": 1, "b": 1, "c": 2}
    assert ranking.cluster_ranks({"a": np.ones(5)}) == {"a": 1}
    assert ranking._chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)


def test_halstead_guards(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (2, 4, 6, 8)], "halstead_eta1 int, halstead_eta2 int, halstead_total1 int, halstead_total2 int")
    empty, full = metrics.halstead(df).collect()
    assert empty.volume is None and empty.difficulty is None and full.difficulty == 2.0 and full.volume == pytest.approx(14 * np.log2(6))


def test_validation(spark):
    good = spark.createDataFrame([("2020-01-01", 1, 1.0)], "date string, label int, x double")
    assert tables.validate(good, "date", "label", ["x"]) is good
    for bad in (good.withColumn("label", F.lit(2)), good.withColumn("x", F.lit(float("nan"))), good.withColumn("date", F.lit(None).cast("string")), good.drop("x"), good.withColumn("x", F.lit("a"))):
        with pytest.raises(ValueError):
            tables.validate(bad, "date", "label", ["x"])


def test_stage_sets():
    assert all(c in stages.CATEGORIES["kamei_coupling"] for c in ("current_method_in_coupling_mean", "current_method_out_coupling_std"))
    assert "current_method_global_var_count_max" in stages.CATEGORIES["kamei_global_var"]
    every = [c.lower() for k in stages.CATEGORIES for c in stages.CATEGORIES[k]]
    assert len(every) == len(set(every)) == 83  # also where case doesn't count
    assert [len(stages.category_features(k)) for k in stages.CATEGORIES] == [14, 18, 22, 58, 26, 22, 18, 17]
    assert len(model.grid()) == 36 and all(a == b for _, a, b in [(0, f[0], f[1]) for f in model.forward_folds(120)])


def test_stages(spark):
    rng = random.Random(7)
    rows = [("d", i, i, int(rng.random() < 0.4)) for i in range(70)]
    df = spark.createDataFrame([(*r, r[3] + rng.random(), rng.random()) for r in rows], "dataset string, commit_id long, date long, label int, la double, current_cc_mean double")
    point = [{"trees": 3, "features": "sqrt", "leaf": 1}]
    one = stages.univariate(df, ["la", "current_cc_mean"], ("spearman", "kendall"))
    assert {r.concept: r.consensus_rank for r in one["consensus_ranking"].collect()} == {"cc": 1, "la": 1}  # one dataset cannot tell them apart
    two = stages.forest(df, ["la", "current_cc_mean"], bootstraps=1, points=point)
    total = two["raw_mdi"].groupBy("window_id", "bootstrap_id").agg(F.sum("importance").alias("s")).collect()
    assert total and all(r.s == pytest.approx(1) for r in total) and {r.bootstrap_id for r in total} == {1} and min(r.window_id for r in total) == 1
    ranks = two["raw_mdi_npsk_ranks"].select("concept", "meta_mdi_npsk_rank", "mean_rank")
    three = stages.top_k(df, ranks, (50, 100), repeats=1, points=point)
    assert three["topk_performance"].count() == 3 * two["time_windows"].filter("used_for_modeling").count()
    four = stages.categories(df, {"a": ["la"], "b": ["la", "current_cc_mean"]}, repeats=1, points=point)
    assert {r.experiment for r in four["stage4_median_across_datasets"].collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        stages.categories(df, {"a": ["nothing"]}, 1, point)


def test_form_feeds_stay_in_lines(spark):
    """Lines of a diff end at line feeds alone, whatever else a text editor may break at."""
    df = spark.createDataFrame([("@@ -0,0 +1,2 @@\n+a\x0cb\u2028c\n+d\r\n",), (None,), ("no hunk\n+x",)], "diff string")
    got = diff.parse_unified(df).collect()
    assert [tuple(x) for x in got[0].added] == [(1, "a\x0cb\u2028c"), (2, "d")] and got[0].deleted == []
    assert got[1].added == [] and got[2].added == []


def test_new_files_of_commits_without_files(spark):
    changes = spark.createDataFrame([(1, "ADD", None, "a"), (1, "MODIFY", "b", "b")], "commit_id long, change_type string, old_path string, new_path string")
    commits = spark.createDataFrame([(1,), (2,)], "commit_id long")
    got = {r.commit_id: (r.current_new_file_count, r.current_new_file_ratio) for r in rollup.new_files(changes, commits).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0)}


def test_git_folders_are_not_source(spark):
    df = spark.createDataFrame([("a/.git/x.foo",), ("a/b.git",), ("a/b.foo",), ("a/b.png",)], "p string")
    assert [r.s for r in df.select(P.other_source(F.col("p")).alias("s")).collect()] == [False, False, True, False]
