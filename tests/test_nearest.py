"""Nearest and containing ranges against brute force over odd rows, and that no step makes a group's product."""

import random

import pytest

from gleaner.operators import affected, calls, metrics


def last(x):
    """Order with nulls last."""
    return (x is None, x if x is not None else 0)


def far(a, b):
    return last(None if a is None or b is None else abs(a - b))


def most_rows(df):
    """The most rows that a step of df's plan gives."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def odd(rng, x):
    return None if rng.random() < 0.08 else x


METHODS = "method int, file string, cls string, name string, start int, language string"


def _methods(rng, n):
    return [(odd(rng, i), odd(rng, f"f{rng.randrange(2)}"), odd(rng, rng.choice(["", "A", "B"])), odd(rng, rng.choice("xyz")), odd(rng, rng.randrange(30)), "java") for i in range(n)]


def test_callers_with_nulls(spark):
    rng = random.Random(1)
    ms = _methods(rng, 120)
    sites = [(i, odd(rng, rng.choice([-1, rng.randrange(150)])), odd(rng, f"f{rng.randrange(3)}"), odd(rng, rng.choice(["", "A", "?"])), odd(rng, rng.choice("xyw")), odd(rng, rng.randrange(40))) for i in range(150)]
    want = {}
    for site, own, file, cls, name, line in sites:
        for tier, key in enumerate(((own,), (file, cls, name), (file, name)), 1):
            mine = lambda m: ((m[0],), (m[1], m[2], m[3]), (m[1], m[3]))[tier - 1]  # noqa: E731, B023
            hits = [m for m in ms if None not in key and mine(m) == key]
            if hits:
                want[site] = (tier, min(hits, key=lambda m: (far(m[4], line), last(m[1]), last(m[4]), last(m[0])))[0])  # noqa: B023
                break
    got = calls.resolve_callers(spark.createDataFrame(sites, "site int, caller_id int, file string, cls string, name string, line int"), spark.createDataFrame(ms, METHODS))
    assert {r.site: (r.tier, r.caller) for r in got.collect()} == want and len(want) > 80


def test_callers_make_no_product(spark):
    n = 400
    ms = spark.createDataFrame([(i, "f", "A", "x", i % 50, "java") for i in range(n)], METHODS)
    sites = spark.createDataFrame([(i, -1, "f", "?", "x", i % 60) for i in range(n)], "site int, caller_id int, file string, cls string, name string, line int")
    assert most_rows(calls.resolve_callers(sites, ms)) <= 8 * n


def test_callees_with_nulls(spark):
    rng = random.Random(2)
    ms = _methods(rng, 120) + [(500 + i, "f0", "", f"only{i}", i, "java") for i in range(5)]
    sites = [(i, odd(rng, f"f{rng.randrange(3)}"), odd(rng, rng.choice(["", "A"])), odd(rng, rng.randrange(40)), "java", odd(rng, rng.choice(["x", "y", "only3", "no"])), None, odd(rng, "p.B"), None) for i in range(150)]
    names = [m[3] for m in ms]
    want = {}
    for site, file, cls, at, _, callee, _, inferred, _ in sites:
        of = inferred and inferred.split(".")[-1]
        tiers = {
            1: lambda m: cls and m[2] == cls and m[1] == file is not None,  # noqa: B023
            2: lambda m: m[1] == file is not None,  # noqa: B023
            3: lambda m: of and m[2] == of,  # noqa: B023
            11: lambda m: names.count(m[3]) == 1,
        }
        for tier, on in tiers.items():
            hits = [m for m in ms if callee is not None and m[3] == callee and on(m)]  # noqa: B023
            if hits:
                want[site] = (tier, min(hits, key=lambda m: (far(m[4], at), last(m[1]), last(m[4]), last(m[0])))[0])  # noqa: B023
                break
    s = spark.createDataFrame(sites, SITES)
    assert {r.site: (r.tier, r.callee) for r in calls.resolve_callees(s, spark.createDataFrame(ms, METHODS)).collect()} == want and {x for x, _ in want.values()} == {1, 2, 3, 11}


SITES = "site int, file string, cls string, start int, language string, callee string, receiver string, inferred string, dotted string"


def test_callees_make_no_product(spark):
    n = 400
    ms = spark.createDataFrame([(i, f"f{i}", "A", "x", i % 50, "java") for i in range(n)], METHODS)
    sites = spark.createDataFrame([(i, "g", "", i % 60, "java", "x", None, "p.A", None) for i in range(n)], SITES)
    assert most_rows(calls.resolve_callees(sites, ms)) <= 8 * n


SPAN = "method int, file string, cls string, name string, start int, end int"


def _spans(rng, n, lines=40):
    """Ranges with nulls, and some that end before they start."""
    out = []
    for i in range(n):
        a = rng.randrange(lines)
        out.append((odd(rng, i), odd(rng, f"f{rng.randrange(2)}"), odd(rng, rng.choice("AB")), odd(rng, rng.choice("xy")), odd(rng, a), odd(rng, a + rng.choice([-2, 0, 1, 3, 9, 30]))))
    return out


def meets(a, b, c, d):
    """As greatest(a, c) <= least(b, d) goes in SQL: a null is passed over."""
    top, low = [x for x in (a, c) if x is not None], [x for x in (b, d) if x is not None]
    return max(top) <= min(low) if top and low else None


@pytest.mark.parametrize("seed", range(3))
def test_targets_with_nulls(spark, seed):
    rng = random.Random(seed)
    ms = _spans(rng, 60)
    ts = sorted({(m[1], m[3], odd(rng, f"{rng.choice('AC')}::{m[3]}"), m[4], m[5]) for m in _spans(rng, 120)}, key=repr)
    want = {}
    for file, name, long_name, a, b in ts:
        hits = [m for m in ms if file is not None and name is not None and (m[1], m[3]) == (file, name)]
        if hits:
            order = {True: 0, False: 1, None: 2}
            want[file, name, long_name, a, b] = min(hits, key=lambda m: (m[2] is None or long_name is None or m[2] != long_name[0], order[meets(a, b, m[4], m[5])], far(m[4], a), last(m[0])))[0]  # noqa: B023
    t = spark.createDataFrame(ts, "file string, name string, long_name string, start int, end int")
    got = affected.match_targets(t, spark.createDataFrame(ms, SPAN), ["file"])
    assert {tuple(r)[:5]: r.method for r in got.collect()} == want and len(want) > 60


def test_targets_make_no_product(spark):
    n = 400
    ms = spark.createDataFrame([(i, "f", "A", "x", i % 50, i % 50 + i % 7) for i in range(n)], SPAN)
    ts = spark.createDataFrame([("f", "x", "A::x", i % 60, i % 60 + 2 + i // 60) for i in range(n)], "file string, name string, long_name string, start int, end int")
    assert most_rows(affected.match_targets(ts, ms, ["file"])) <= 20 * n


@pytest.mark.parametrize("seed", range(2))
def test_smallest_enclosing_with_nulls(spark, seed):
    rng = random.Random(seed)
    ms, ns = _spans(rng, 100), [(*m, odd(rng, rng.randrange(9))) for m in _spans(rng, 80)]
    want = {}
    for i, file, _, _, a, b in ms:
        hits = [n for n in ns if None not in (file, a, b, n[4], n[5]) and n[1] == file and n[4] <= a and n[5] >= b]
        if hits:
            want.setdefault(i, []).append(min((last(n[6]), last(n[0])) for n in hits))
    nodes = spark.createDataFrame(ns, SPAN + ", size int").withColumnRenamed("method", "node").drop("cls", "name")
    got = metrics.smallest_enclosing(spark.createDataFrame(ms, SPAN), nodes, ["file"], "method")
    assert {r.method: r.node for r in got.collect()} == {i: None if (x := min(w)[1])[0] else x[1] for i, w in want.items()} and len(want) > 50


def test_smallest_enclosing_makes_no_product(spark):
    n = 400
    ms = spark.createDataFrame([(i, "f", "A", "x", i % 50, i % 50 + i % 7) for i in range(n)], SPAN)
    nodes = ms.selectExpr("file", "start - 2 AS start", "end + 2 AS end", "method AS node", "end - start + 4 AS size")
    assert most_rows(metrics.smallest_enclosing(ms, nodes, ["file"], "method")) <= 12 * n


@pytest.mark.parametrize("seed", range(2))
def test_metric_space_with_nulls(spark, seed):
    rng = random.Random(seed)
    ms, ss = _spans(rng, 100), _spans(rng, 80)
    ms = [m for m in ms if m[0] is not None]
    want = {}
    for i, file, _, _, a, b in ms:
        hits = [(far(s[4], a), last(s[4]), last(s[0])) for s in ss if file is not None and s[1] == file and meets(a, b, s[4], s[5])]
        want[i] = min(hits)[2] if hits else (True, 0)
    spaces = spark.createDataFrame(ss, SPAN).selectExpr("file", "start", "end", "method AS value")
    got = metrics.metric_space(spark.createDataFrame(ms, SPAN), spaces, ["file"], "method", ["value"])
    assert {r.method: r.value for r in got.collect()} == {i: None if x[0] else x[1] for i, x in want.items()}


def test_metric_space_makes_no_product(spark):
    n = 400
    ms = spark.createDataFrame([(i, "f", "A", "x", i % 50, i % 50 + i % 7) for i in range(n)], SPAN)
    spaces = ms.selectExpr("file", "start + 4 AS start", "end + 4 AS end", "method AS value")
    assert most_rows(metrics.metric_space(ms, spaces, ["file"], "method", ["value"])) <= 12 * n
