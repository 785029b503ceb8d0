"""Every registered core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gleaner.plans import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    done = con.execute(queries.SQL[name])
    names = [d[0] for d in done.description]
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in done.fetchall())
    assert sorted(names) == columns and got == want


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_forest_query_runs_the_whole_stage(spark, monkeypatch):
    """All datasets and commits, the stage's own bootstraps, and a tuning step that sees the full grid."""
    from gleaner.operators import model
    from gleaner.plans import stages

    class Fitted(Exception):
        pass

    seen, forest, tune = {}, stages.forest, model.tune

    def whole(rows, *a, **k):
        seen.update(rows=rows.count(), datasets=rows.select("dataset").distinct().count(), more=k | dict(enumerate(a[1:])))
        return forest(rows, *a, **k)

    def tuned(df, n, seed, points, *a):
        seen["points"] = points
        return tune(df, n, seed, points, *a)

    def fit(*a, **k):
        raise Fitted

    monkeypatch.setattr(stages, "forest", whole)
    monkeypatch.setattr(model, "tune", tuned)
    monkeypatch.setattr(model, "fit", fit)
    with pytest.raises(Fitted):
        queries.rf_mdi(spark, DIR)
    orders = spark.read.parquet(f"{DIR}/orders.parquet")
    assert (seen["rows"], seen["datasets"]) == (orders.count(), orders.select("o_orderpriority").distinct().count())
    assert seen["more"] == {} and seen["points"] == model.grid()
