"""A small repository, from git to the three tables."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from gleaner.operators import calls
from gleaner.plans import analyzer
from gleaner.sources import measures

A1 = "LIMIT = 3\n\n\ndef low(x, y):\n    # a comment\n    if x > LIMIT:\n        return y\n    return x\n\n\nclass Box:\n    size = 1\n\n    def grow(self):\n        return low(self.size, 2)\n"
A2 = A1.replace("return y", "return y + LIMIT").replace("low(self.size, 2)", "self.shrink()") + "\n    def shrink(self):\n        return low(1, 2)\n"
JAVA = "package a;\nimport a.util.Tool;\n\nclass Main {\n  int total = 0;\n\n  int add(int a, int b) {\n    int sum = a + b;\n    total = sum;\n    if (sum > 0 && a > 1) { return sum; }\n    return 0;\n  }\n\n  void go() {\n    Tool t = new Tool();\n    t.work(add(1, 2));\n  }\n}\n"
TOOL = "package a.util;\n\nclass Tool {\n  void work(int n) {\n    n = n + 1;\n  }\n}\n"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("analysed")
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q")
    run("config", "user.email", "a@b.c")
    run("config", "user.name", "a")
    for i, files in enumerate([{"a.py": A1}, {"a.py": A2, "Main.java": JAVA, "Tool.java": TOOL}, {"notes.txt": "x"}]):
        for name, text in files.items():
            (root / name).write_text(text)
        run("add", "-A")
        subprocess.run(["git", "-C", str(root), "commit", "-q", "-m", str(i)], check=True, env=os.environ | {"GIT_AUTHOR_DATE": f"2024-01-0{i + 1}T00:00:00Z", "GIT_COMMITTER_DATE": f"2024-01-0{i + 1}T00:00:00Z"})
    got = analyzer.analyze(spark, str(root))
    order = [r.commit_id for r in got["commit"].orderBy("commit_author_date").collect()]
    return {k: df.persist() for k, df in got.items()}, order, root


def test_functions(tables):
    got, order, _ = tables
    assert got["function"].columns == list(analyzer.FUNCTION_COLUMNS) and len(got["function"].columns) == 40
    rows = {(order.index(r.commit_id), r.method_name): r for r in got["function"].collect()}
    assert set(rows) == {(0, "low"), (0, "grow"), (1, "low"), (1, "grow"), (1, "shrink"), (1, "add"), (1, "go"), (1, "work")}
    low, add = rows[(0, "low")], rows[(1, "add")]
    assert (low.method_in_coupling, low.method_out_coupling, low.method_cc, low.method_nargs, low.method_nexits) == (1, 0, 2, 2, 2)
    assert (low.method_global_var_count, low.file_nom, low.file_class, low.file_cloc, low.class_name) == (1, 2, 1, 1, "")
    assert (low.node_count, low.file_count, low.language, low.start_line, low.end_line) == (2, 1, "python", 4, 8)
    assert (rows[(1, "low")].method_in_coupling, rows[(1, "shrink")].method_in_coupling, rows[(1, "grow")].method_out_coupling) == (1, 1, 1)
    assert (add.method_in_coupling, add.method_nargs, add.method_cc, add.method_nexits, add.method_global_var_count) == (1, 2, 3, 2, 1)
    assert rows[(1, "go")].method_out_coupling == 2 and rows[(1, "work")].method_in_coupling == 1  # by its receiver's type
    assert add.method_halstead_volume == pytest.approx(add.method_halstead_length * __import__("math").log2(add.method_halstead_vocabulary))
    assert add.file_mi is not None and add.method_id == "Main.java::Main::add::7"


def test_commits(tables):
    got, order, _ = tables
    rows = {order.index(r.commit_id): r for r in got["commit"].collect()}
    assert [rows[i].modified_method_count_current for i in range(3)] == [2, 6, 0]
    assert [rows[i].current_new_file_count for i in range(3)] == [1, 2, 1] and rows[1].current_new_file_ratio == pytest.approx(2 / 3)
    assert [rows[i].has_modified_methods_current for i in range(3)] == [True, True, False] and [rows[i].class_touched_count_current for i in range(3)] == [1, 3, 0]
    functions = got["function"].filter(F.col("commit_id") == order[1])
    for m in analyzer.METHOD_METRICS:
        want = functions.agg(F.avg(m).alias("a"), F.max(m).alias("b"), F.min(m).alias("c"), F.stddev_pop(m).alias("d")).first()
        assert [rows[1][f"current_{m}_{k}"] for k in ("mean", "max", "min", "std")] == [pytest.approx(x) for x in want]
    assert rows[1].current_file_nom_max == 3 and rows[0].is_complete_feature and rows[2].current_method_cc_mean is None and not rows[2].is_complete_feature


def test_written(tables, spark, tmp_path):
    got, _, root = tables
    analyzer.run(spark, str(root), str(tmp_path / "out"), fmt="parquet", languages=["python"], limit=2)
    assert spark.read.parquet(str(tmp_path / "out_commit")).count() == 2
    assert {r.language for r in spark.read.parquet(str(tmp_path / "out_function")).collect()} == {"python"}
    assert spark.read.parquet(str(tmp_path / "out_file")).count() == 2


def test_symbols():
    methods, found, imports, counts = measures.measure("a.py", "python", "import os.path as p\ng = 1\n\n\ndef f(a, *b, c=2):\n    global h\n    h = g\n    k = p.join(a)\n    return k\n")
    assert [(m["refs"], m["locals"], m["declared"], m["file_symbols"], m["nargs"]) for m in methods] == [(["a", "g", "h", "k", "p"], ["a", "b", "c", "k"], ["h"], ["g"], 3)]
    assert imports == [{"alias": "p", "target": "os.path"}] and counts["nom"] == 1 and [c["callee"] for c in found] == ["join"]
    assert [m["name"] for m in measures.measure("x.py", "python", "def broken(:\n  pass\n")[0]] in ([], ["broken"])
    java = measures.measure("Main.java", "java", JAVA)
    add = next(m for m in java[0] if m["name"] == "add")
    assert {"a", "b", "sum"} <= set(add["locals"]) and add["class_symbols"] == ["total"] and "total" in add["refs"]
    assert {"alias": "Tool", "target": "a.util.Tool"} in java[2] and next(c for c in java[1] if c["callee"] == "work")["inferred"] == "Tool"
    assert [measures.n_args(x) for x in ("f()", "f(a)", "f(a, b(c, d), e)", "f", "f( )")] == [0, 1, 3, 0, 0]


def test_every_tier_of_calls(spark):
    """One site for each tier of the cascade; the first tier with a hit wins."""
    methods = spark.createDataFrame(
        [(1, "p/a.py", "C", "m", 1), (2, "p/a.py", "", "n", 9), (3, "p/b.py", "D", "o", 1), (4, "p/c.py", "", "q", 1), (5, "p/c.py", "E", "r", 5), (6, "p/d.py", "", "only", 1), (7, "x/e.py", "D", "o", 1), (8, "x/f.py", "E", "r", 1), (9, "x/f.py", "", "q", 2), (10, "x/a.py", "", "n", 1)],
        "method int, file string, cls string, name string, start int",
    ).withColumn("language", F.lit("python"))
    imports = spark.createDataFrame([("p/a.py", "dd", "p.b.D"), ("p/a.py", "c", "p.c"), ("p/a.py", "alias", "p.c.q"), ("p/a.py", "ee", "p.c.E")], "file string, alias string, target string")
    sites = [(1, "C", "m", None, None, None), (2, "C", "n", None, None, None), (3, "C", "o", None, "z.D", None), (4, "C", "o", "dd", None, "dd.o"), (8, "", "q", None, None, "c.q"), (9, "", "alias", None, None, None), (11, "", "only", None, None, None), (12, "", "unknown", None, None, None), (7, "", "r", "ee", None, None)]
    df = spark.createDataFrame(sites, "site int, cls string, callee string, receiver string, inferred string, dotted string").withColumns({"file": F.lit("p/a.py"), "start": F.lit(1), "language": F.lit("python")})
    got = {r.site: (r.tier, r.callee) for r in calls.resolve_callees(df, methods, imports).collect()}
    assert got == {1: (1, 1), 2: (2, 2), 3: (3, 3), 4: (4, 3), 8: (8, 4), 9: (9, 4), 11: (11, 6), 7: (4, 8)}
    both = methods.withColumn("c", F.lit("x")).unionByName(methods.withColumn("c", F.lit("y")).withColumn("method", F.col("method") + 100))
    within = calls.resolve_callees(df.withColumn("c", F.lit("y")), both, imports.withColumn("c", F.lit("y")), ["c"])
    assert {r.site: (r.tier, r.callee - 100) for r in within.collect()} == got
