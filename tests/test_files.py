"""CSV datasets, shards, JSON reports, and the sharded analysis."""

import json
import os
import subprocess

import pytest

from gleaner.operators import tables
from gleaner.plans import analyzer, shards
from gleaner.sources import files


def test_datasets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when,bug,la,note\n2024-01-01T00:00:00Z,1,2.5,x\nbad,0,None,y\n")
    (tmp_path / "b.csv").write_text("la,when,bug\n7,2024-01-02 00:00:00,0.0\n")
    got = files.read_datasets(spark, {"A": str(tmp_path / "a.csv"), "B": str(tmp_path / "b.csv")}, "when", "bug")
    assert got.columns == ["dataset", "when", "bug", "la"]
    rows = sorted((r.dataset, r.bug, r.la, r.when is None) for r in got.collect() if r.la)
    assert rows == [("A", 1, 2.5, False), ("B", 0, 7.0, False)]
    report = {r.rule: r.violations for r in tables.validation_report(got, "when", "bug", ["la"]).collect()}
    assert report["null_date"] == 1 and report["bad_la"] == 1
    with pytest.raises(ValueError):
        files.read_datasets(spark, {"A": str(tmp_path / "a.csv")}, "when", "label")
    with pytest.raises(ValueError):
        files.read_datasets(spark, {}, "when", "bug")


def test_shards(spark, tmp_path):
    (tmp_path / "0.csv").write_text('id,text\n1,"a, ""b""\nc"\n2,None\n')
    (tmp_path / "1.csv").write_text("")
    (tmp_path / "3.csv").write_text("text,more,id\nz,m,3\n")
    got = files.read_shards(spark, [str(tmp_path / f"{i}.csv") for i in range(4)])
    assert sorted((r.id, r.text, r.more) for r in got.collect()) == [("1", 'a, "b"\nc', None), ("2", None, None), ("3", "z", "m")]
    with pytest.raises(ValueError):
        files.read_shards(spark, [str(tmp_path / "1.csv"), str(tmp_path / "9.csv")])


def test_reports(spark, tmp_path):
    report = {"name": "f", "spaces": [{"start_line": 9, "Cyclomatic": {"sum": 4, "mean": 2.0}}], "start_line": 3, "metrics": {"nargs": {"x": {"deep": [None, 5]}}, "total_cyclomatic": 8, "loc": "no", "flag": True}}
    (tmp_path / "a.json").write_text(json.dumps(report))
    (tmp_path / "b.json").write_text("not json")
    (tmp_path / "c.json").write_text("")
    got = files.read_reports(spark, str(tmp_path / "*.json"))
    e = got.entries
    cols = [files.number_by_alias(e, ["CYCLOMATIC"]), files.number_by_alias(e, ["total_cyclomatic"], exact=True), files.number_by_alias(e, ["nargs"]), files.line_by_alias(e, ["line"]), files.number_by_alias(e, ["loc"]), files.number_by_alias(e, ["flag"])]
    rows = {os.path.basename(r[0]): tuple(r)[1:] for r in got.select("path", *cols).collect()}
    assert rows == {"a.json": (4.0, 8.0, 5.0, 3, None, 1.0), "b.json": (None,) * 6}
    assert files.entries("") == files.entries(None) == []


def test_truth():
    assert files.truth(" Yes") and files.truth("1") and not files.truth("n")
    with pytest.raises(ValueError):
        files.truth("maybe")


def test_sharded_analysis(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q"), run("config", "user.email", "a@b.c"), run("config", "user.name", "a")
    for i in range(3):
        (root / "a.py").write_text(f"def f(x):\n    return x + {i}\n")
        run("add", "-A"), run("commit", "-qm", str(i))
    base = str(tmp_path / "out")
    assert shards.run(spark, str(root), base, shards=2) == [0, 1]
    whole = analyzer.analyze(spark, str(root))
    for table in shards.TABLES:
        got, want = files.read_csv(spark, f"{base}_{table}"), whole[table]
        assert sorted(r.commit_id for r in got.select("commit_id").collect()) == sorted(r.commit_id for r in want.select("commit_id").collect())
    assert shards.run(spark, str(root), base, shards=2) == []
    with pytest.raises(ValueError):
        shards.run(spark, str(root), base, shards=0)
