"""Calibration, separation, parity, tree scores, cones and facts against plain loops on small frames."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from barsmith.operators import cones, evaluation as ev, facts

START = dt.date(2020, 1, 1)


def isotonic(points):
    """score: value by the min-max formula."""
    xs = sorted({s for s, _ in points})
    mean = lambda a, b: statistics.mean(y for s, y in points if xs[a] <= s <= xs[b])
    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 4), (3, 40)])
def test_isotonic_is_the_min_max_formula(spark, seed, parts):
    rng = random.Random(seed)
    points = [(s := round(rng.random(), 2), int(rng.random() < 0.2 + 0.5 * s)) for _ in range(150)]
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(parts))
    try:
        df = spark.createDataFrame([*points, (None, 1), (0.5, None)], "s double, y int")
        model = ev.isotonic_fit(df, "s", "y", fan_in=3).cache()
        got = {r.s: r.calibrated for r in ev.isotonic_transform(df.where("s is not null").select("s").distinct(), "s", model).collect()}
    finally:
        spark.conf.set(key, before)
    want = isotonic(points)
    assert all(math.isclose(got[s], v, abs_tol=1e-12) for s, v in want.items())
    blocks = sorted(map(tuple, model.collect()))
    assert [b[2] for b in blocks] == sorted({b[2] for b in blocks}) and sum(b[3] for b in blocks) == len(points)


def test_isotonic_between_and_beyond(spark):
    model = spark.createDataFrame([(0.2, 0.4, 0.1, 5), (0.8, 0.8, 0.5, 5)], "lo double, hi double, value double, n long")
    got = [r.calibrated for r in ev.isotonic_transform(spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.6, 0.9, None)], "s double").coalesce(1), "s", model).collect()]
    assert got[:4] == pytest.approx([0.1, 0.1, 0.3, 0.5]) and got[4] is None


def test_separation(spark):
    rng = random.Random(7)
    rows = [(rng.choice([True, False, None]), rng.choice([None, float("nan"), *[rng.gauss(0, 1) for _ in range(9)]]), float(rng.randint(0, 3))) for _ in range(400)]
    got = {r.feature: r for r in ev.separation(spark.createDataFrame(rows, "g boolean, a double, b double"), ["a", "b"], F.col("g"), parts=5).collect()}
    for k, name in ((1, "a"), (2, "b")):
        pos, neg = ([r[k] for r in rows if r[0] is side and r[k] is not None and r[k] == r[k]] for side in (True, False))
        xs = sorted({*pos, *neg})
        gap = [abs(sum(v <= x for v in pos) / len(pos) - sum(v <= x for v in neg) / len(neg)) for x in xs]
        r = got[name]
        assert (r.n_pos, r.n_neg) == (len(pos), len(neg)) and math.isclose(r.ks, max(gap)) and math.isclose(r.mean_pos, statistics.mean(pos), abs_tol=1e-12)
        assert math.isclose(r.wasserstein, sum(g * (b - a) for g, a, b in zip(gap, xs, xs[1:], strict=False)))


def test_parity(spark):
    left = spark.createDataFrame([("a", 1.0, "x", 1), ("a", 2.0, "y", 1), ("b", None, "z", 1), ("c", 1e9, None, 1), (None, 5.0, "n", 1)], "k string, v double, w string, mine int")
    right = spark.createDataFrame([("a", 2.0, "y", "q"), ("a", 1.0, "x", "q"), ("b", 3.0, "Z", "q"), ("c", 1e9 + 0.1, None, "q"), (None, 5.5, "n", "q"), ("d", 1.0, "", "q"), ("d", 1.0, "", "q")], "k string, v double, w string, yours string")
    got = {r.column_name: tuple(r)[1:] for r in ev.parity(left, right, ["k"]).collect()}
    assert got["v"][:5] == ("number", 5, 3, 1, 1) and got["v"][5] == 0.5
    assert got["w"] == ("text", 5, 4, 0, 1, None)
    assert got["only_right"][4] == 2 and got["only_left"][4] == 0
    assert got["mine"][0] == got["yours"][0] == "missing"
    assert all(r.equal == r.compared and not r.value_mismatch for r in ev.parity(left, left.orderBy("w"), ["k"]).collect())


def test_tree_scores(spark):
    nodes = [(0, 0, "Size", 2.0, 1, 2, None), (0, 1, None, None, None, None, 1.0), (0, 2, "age", 5.0, 3, 4, None), (0, 3, None, None, None, None, 10.0), (0, 4, None, None, None, None, 100.0), (1, 0, None, None, None, None, 0.5)]
    trees = spark.createDataFrame(nodes, "tree int, node int, feature string, threshold double, left int, right int, value double")
    rows = spark.createDataFrame([(1, 1.0, 9.0), (2, 2.0, 4.0), (3, 3.0, 5.0), (4, None, 1.0), (5, 7.0, None)], "id int, size double, AGE double")
    got = {r.id: r.score for r in ev.tree_scores(rows, trees, ["size", "AGE"], base=0.25).collect()}
    assert got == {1: 1.75, 2: 10.75, 3: 100.75, 4: 10.75, 5: 100.75}
    with pytest.raises(ValueError, match="age"):
        ev.tree_scores(rows, trees, ["size"])
    assert [r.score for r in ev.tree_scores(rows.limit(1), trees.limit(0), ["size"], base=0.25).collect()] == [0.25]


@pytest.mark.parametrize("n,horizon", [(60, 7), (23, 20), (5, 5)])
def test_cones_by_single_paths(spark, n, horizon):
    rng = random.Random(n)
    series = {b: [rng.gauss(0.001, 0.02) for _ in range(n)] for b in "ab"}
    day = [START + dt.timedelta(3 * k) for k in range(n)]
    df = spark.createDataFrame([(b, day[k], r) for b, rs in series.items() for k, r in enumerate(rs)], "book string, date date, r double")
    got = {(r.book, r.start_date): r for r in cones.cone_cells(df, horizon).collect()}
    assert len(got) == 2 * max(0, n - horizon)
    for b, rs in series.items():
        for k in range(n - horizon):
            path, level, top, fall = rs[k + 1:k + 1 + horizon], 1.0, 1.0, 0.0
            for r in path:
                level *= 1 + r
                top = max(top, level)
                fall = max(fall, 1 - level / top)
            r = got[b, day[k]]
            assert math.isclose(r.total_return, level - 1, abs_tol=1e-12) and math.isclose(r.max_drawdown, fall, abs_tol=1e-12) and r.end_date == day[k + horizon]
            assert math.isclose(r.sharpe, statistics.mean(path) / statistics.stdev(path) * 252**0.5, rel_tol=1e-9)
    pooled = {r.date: r.r for r in cones.pooled_returns(df, horizon).collect()}
    seen = {}
    for rs in series.values():
        for k in range(n - horizon):
            for q in range(k + 1, k + 1 + horizon):
                seen.setdefault(day[q], []).append(rs[q])
    assert set(pooled) == set(seen) and all(math.isclose(pooled[d], statistics.mean(v), abs_tol=1e-12) for d, v in seen.items())


def test_alpha_beta_and_gates(spark):
    rng = random.Random(1)
    rows = [(START + dt.timedelta(k), 0.001 + 1.5 * b, b) for k, b in enumerate(rng.gauss(0, 0.01) for _ in range(30))]
    df = spark.createDataFrame(rows, "date date, r double, b double")
    fit = cones.alpha_beta(df.select("date", "r"), df.select("date", "b"))
    row = fit.first()
    assert row.beta == pytest.approx(1.5) and row.alpha == pytest.approx(0.252)
    assert cones.alpha_beta(df.select("date", "r").limit(5), df.select("date", "b")).first().beta is None
    assert {r.gate: r.passes for r in cones.gates(fit, {"alpha": (">", 0.2), "beta": ("<", 1.0)}).collect()} == {"alpha": True, "beta": False}


def test_facts(spark):
    d = lambda m, day=1: dt.date(2023, m, day)
    q, y = d(7), d(1)
    end = d(9, 30)
    rows = [
        ("A", "Old", "USD", "10-Q", q, end, d(10), 5.0), ("A", "New", "USD", "10-Q", y, end, d(12), 90.0), ("A", "New", "USD", "10-Q", q, end, d(10), 30.0), ("A", "New", "USD", "10-Q", q, end, d(11), 31.0),
        ("A", "New", "EUR", "10-Q", q, end, d(12), 1.0), ("A", "Held", "USD", "10-Q", None, end, d(10), 7.0), ("A", "Held", "USD", "10-Q", None, end, d(11), 8.0), ("A", "New", "USD", "8-K", q, end, d(12), 2.0),
        ("B", "Held", "USD", "10-Q", None, end, d(10), 7.0), ("C", "Old", "USD", "10-K", y, d(12, 31), d(12, 31), 4.0), ("C", "New", "USD", "10-K", y, d(12, 31), d(12, 31), None), ("D", "Old", "USD", "10-Q", q, dt.date(2019, 9, 30), d(10), 5.0),
    ]
    df = spark.createDataFrame(rows, "entity string, tag string, unit string, form string, start date, end date, filed date, value double")
    concepts = [facts.Concept("revenue", "USD", ("New", "Old"), True), facts.Concept("assets", "USD", ("Held",), False)]
    got = {r.entity: (r.revenue, r.assets, r.period_type) for r in facts.resolve_facts(df, concepts, ("10-K", "10-Q"), "10-K", "2020-01-01").collect()}
    assert got == {"A": (31.0, 8.0, "quarterly"), "C": (4.0, None, "annual")}
