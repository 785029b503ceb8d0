"""The git source on a small repository, the parsers, and the stream."""

import os
import subprocess

import pytest

from gleaner.functions.paths import language_of
from gleaner.operators import diff
from gleaner.sources import gitlog, parsing
from gleaner.streaming import commit_feed


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("repo"))
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x"}
    run = lambda *a: subprocess.run(["git", "-C", at, *a], check=True, capture_output=True, env=env)

    def put(name, text):
        with open(f"{at}/{name}", "w") as f:
            f.write(text)

    run("init", "-q", "-b", "main")
    put("a.py", "def f():\n    return g()\n\ndef g():\n    return 1\n")
    put("é.txt", "ü\n")
    run("add", "-A"), run("commit", "-qm", "one")
    put("a.py", "def f():\n    return g()\n\ndef g():\n    return 2\n")
    run("add", "-A"), run("commit", "-qm", "two")
    run("mv", "a.py", "b.py"), run("commit", "-qm", "three")
    run("checkout", "-qb", "side", "HEAD~1"), put("c.py", ""), run("add", "-A"), run("commit", "-qm", "side")
    run("checkout", "-q", "main"), run("rm", "-q", "é.txt"), run("commit", "-qm", "four"), run("merge", "-q", "--no-edit", "side")
    return at


@pytest.fixture(scope="module")
def git(spark):
    spark.dataSource.register(gitlog.GitSource)
    return lambda repo, table, **o: spark.read.format("git").option("repo", repo).option("table", table).options(**o).load()


def test_commits(git, repo):
    rows = git(repo, "commits", rows=2).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(6)) and [r.is_merge for r in rows] == [False] * 5 + [True]
    part = git(repo, "commits", skip=1, limit=2).orderBy("ordinal").collect()
    assert [r.commit_id for r in part] == [r.commit_id for r in rows[1:3]]


def test_changes(git, repo):
    order = {r.commit_id: r.ordinal for r in git(repo, "commits").collect()}
    got = {(order[r.commit_id], r.change_type, r.old_path, r.new_path): r for r in diff.parse_unified(git(repo, "file_changes")).collect()}
    assert {(0, "ADD", None, "a.py"), (0, "ADD", None, "é.txt"), (1, "MODIFY", "a.py", "a.py"), (5, "ADD", None, "c.py")} <= set(got)
    assert any(k[1:] == ("RENAME", "a.py", "b.py") for k in got) and any(k[1:] == ("DELETE", "é.txt", None) for k in got)
    change = got[(1, "MODIFY", "a.py", "a.py")]
    assert [tuple(x) for x in change.added] == [(5, "    return 2")] and [tuple(x) for x in change.deleted] == [(5, "    return 1")]


def test_failures_are_errors(tmp_path):
    with pytest.raises(RuntimeError):
        gitlog.git(str(tmp_path), "rev-list", "HEAD")


def test_snapshots(git, repo, spark):
    blobs = git(repo, "blobs").dropDuplicates(["blob_sha"])
    files = git(repo, "snapshot_files").join(blobs, "blob_sha")
    files = files.withColumn("language", language_of(files.path, ["python"])).filter("language IS NOT NULL")
    distinct = files.select("path", "language", "text").distinct()
    assert {(r.path, r.name, r.start, r.end) for r in parsing.facts(distinct).collect()} == {(p, *m) for p in ("a.py", "b.py") for m in (("f", 1, 2), ("g", 4, 5))}
    assert {(r.caller, r.callee) for r in parsing.facts(distinct, "calls").collect()} == {("f", "g")}


def test_options(tmp_path):
    with pytest.raises(ValueError):
        gitlog.resolve_repo({})
    with pytest.raises(FileNotFoundError):
        gitlog.resolve_repo({"repo": str(tmp_path / "none")})
    with pytest.raises(FileExistsError):
        gitlog.resolve_repo({"url": "x", "repo": str(tmp_path)})


SOURCES = {
    "java": "class A {\n  // run(x)\n  int run(int x) {\n    return this.go(x) + B.help();\n  }\n  void go(int y) { }\n}",
    "javascript": "class A {\n  run(x) { this.go(x); }\n}\nconst f = (a) => { run(a); }\nfunction g() { f(); }",
    "cpp": "int A::run(int x) {\n  return p->go(x);\n}\n",
    "go": "func run(x int) int {\n  return help(x)\n}\n",
    "rust": "impl A {\n  fn run(&self) { self.go(); }\n}\n",
    "ruby": "class A\n  def run(x)\n    go(x)\n  end\nend\n",
    "r": "run <- function(x) {\n  go(x)\n}\n",
    "bash": "function run {\n  echo\n}\n",
}


@pytest.mark.parametrize("language", SOURCES)
def test_parsers(language):
    p = parsing.parse(SOURCES[language], "f", language)
    names = {m[2] for m in p.methods}
    assert "run" in names and all(m[3] <= m[4] for m in p.methods)
    if language == "java":
        assert [(m[1], m[2], m[3], m[4]) for m in p.methods] == [("A", "run", 3, 5), ("A", "go", 6, 6)]
        assert {(c[1], c[4], c[5]) for c in p.calls} == {("run", "go", "A"), ("run", "help", "B")}


def test_every_language_parses():
    for language in parsing.PROFILES:
        parsing.parse("x { y } <a>b</a> def f end \"", "f", language)
    assert parsing.parse(None, "f", "python").methods == [] and parsing.parse("def (", "f", "python").methods == []


def test_python_facts():
    p = parsing.parse("import a.b as c\nfrom m import x as y, z\nclass K:\n    def r(self):\n        self.s(); c.t()\n", "f", "python")
    assert p.imports == {"c": "a.b", "y": "m.x", "z": "m.z"} and p.methods == [("f", "K", "r", 4, 5, "python")]
    assert {(x[4], x[5], x[6]) for x in p.calls} == {("s", "K", "self.s"), ("t", "c", "c.t")}


def test_stream(spark, tmp_path):
    rows = [(i % 7, f"2020-01-01 0{i % 4}:00:00", "a", float(i % 7)) for i in range(14)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "timestamp(ts) AS ts", "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = commit_feed.write_rollup(commit_feed.windowed_rollup(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() >= 1
    assert commit_feed.windowed_rollup(df).count() >= 1
