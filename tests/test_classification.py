"""Reports of classifiers against loops over single rows."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.operators import classification as cl


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(2)
    rows = [(s := round(rng.random(), 2), int(rng.random() < 0.3 + 0.4 * s)) for _ in range(300)]
    return rows, spark.createDataFrame([*rows, (None, 1), (0.5, None)], "s double, y int")


def at(rows, t):
    said, hits, every = sum(s >= t for s, _ in rows), sum(y for s, y in rows if s >= t), sum(y for _, y in rows)
    fp, neg = said - hits, len(rows) - every
    return hits / said, hits / every, 2 * hits / (said + every), said, hits / every - fp / neg


def test_thresholds(points):
    rows, df = points
    got = {r["mode"]: r for r in cl.thresholds(cl.score_counts(df, "s", "y"), 0.6).collect()}
    ts = sorted({s for s, _ in rows})
    lowest = min(t for t in ts if at(rows, t)[0] >= 0.6)
    best = max(at(rows, t)[2] for t in ts)
    f1 = min(t for t in ts if math.isclose(at(rows, t)[2], best))
    top = max(at(rows, t)[4] for t in ts)
    youden = max(t for t in ts if math.isclose(at(rows, t)[4], top, abs_tol=1e-12))
    for mode, t in (("precision_min", lowest), ("f1_max", f1), ("youden", youden)):
        r = got[mode]
        assert r.threshold == t and (r.precision, r.recall, r.f1) == pytest.approx(at(rows, t)[:3]) and r.n_signals == at(rows, t)[3] and r.achievable
    assert not [r for r in cl.thresholds(cl.score_counts(df, "s", "y"), 1.01).collect() if r["mode"] == "precision_min"][0].achievable


def test_quantiles_and_bins(points):
    rows, df = points
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    counts = cl.score_counts(df, "s", "y")
    assert cl.quantiles(counts, shares).first().q == pytest.approx(np.quantile([s for s, _ in rows], shares).tolist())
    table = cl.calibration(df, "s", "y", 5, cl.quantiles(counts, [0.2, 0.4, 0.6, 0.8])).orderBy("bin").collect()
    assert sum(r.n for r in table) == 300 and min(r.n for r in table) > 40
    wide = cl.calibration(df.where("s < 0.35"), "s", "y", 10).orderBy("bin").collect()
    assert len(wide) == 10 and [r.n for r in wide[4:]] == [0] * 6 and wide[9].gap is None
    errors = cl.calibration_errors(cl.calibration(df, "s", "y", 10)).first()
    ece = mce = 0.0
    for b in range(10):
        inside = [(s, y) for s, y in rows if min(max(math.ceil(round(s * 10, 9)) - 1, 0), 9) == b]
        if inside:
            gap = abs(sum(s - y for s, y in inside)) / len(inside)
            ece, mce = ece + gap * len(inside) / 300, max(mce, gap)
    assert (errors.ece, errors.mce, errors.n) == pytest.approx((ece, mce, 300))


def test_averages(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.choice([0, 1, 2, 2, 4])) for _ in range(200)]
    df = spark.createDataFrame(rows, "actual int, predicted int").groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    got = cl.averaged_scores(df).first()
    f1, support = {}, {}
    for c in range(5):
        hit, support[c], said = sum(a == b == c for a, b in rows), sum(a == c for a, _ in rows), sum(b == c for _, b in rows)
        f1[c] = 2 * hit / (support[c] + said)
    accuracy = sum(a == b for a, b in rows) / 200
    assert tuple(got) == pytest.approx((accuracy, sum(f1[c] * support[c] for c in f1) / 200, sum(f1.values()) / 5, accuracy, 200))


def test_rankings(spark):
    d = lambda k: dt.date(2024, 1, k)
    schema = "date date, ticker string, score double"
    left = spark.createDataFrame([(d(1), t, s) for t, s in zip("ABCD", (4.0, 3.0, 2.0, 2.0), strict=True)] + [(d(2), "A", 1.0), (d(2), "B", 1.0), (d(3), "Z", 1.0)], schema)
    right = spark.createDataFrame([(d(1), t, s) for t, s in zip("ABCE", (1.0, 2.0, 3.0, 9.0), strict=True)] + [(d(2), "A", 1.0), (d(2), "B", 5.0)], schema)
    pairs = cl.ranked_pairs(left, right)
    days = {r.date: r for r in cl.ranking_days(pairs, 2).collect()}
    assert len(days) == 2 and (days[d(1)].n_common, days[d(1)].spearman, days[d(1)].disagreements) == (3, pytest.approx(-1.0), 2)
    assert days[d(1)].jaccard == pytest.approx(1 / 3) and days[d(2)].spearman is None and days[d(2)].disagreements == 2
    assert cl.ranking_summary(cl.ranking_days(pairs, 2)).first().disagreements == 4
    assert [(r.ticker, r.rank_delta) for r in cl.largest_disagreements(pairs, 2).collect()] == [("A", 2), ("C", -2)]


def test_drift(spark):
    rng = random.Random(5)
    rows = [(0, rng.gauss(0, 1)) for _ in range(500)] + [(1, rng.gauss(0, 1)) for _ in range(500)] + [(2, rng.gauss(2, 1)) for _ in range(500)] + [(3, 0.0)] * 5
    df = spark.createDataFrame(rows, "p int, x double")
    got = {r.period: r for r in cl.drift_report(df, ["x"], F.col("p") == 0, F.col("p")).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "stable", 2: "major", 3: "thin"}
    edges = np.quantile([x for p, x in rows if p == 0], [k / 10 for k in range(1, 10)])
    share = lambda p: [max(1e-6, np.mean([sum(x > edges) == b for q, x in rows if q == p])) for b in range(10)]
    assert got[2].psi == pytest.approx(sum((b - a) * math.log(b / a) for a, b in zip(share(0), share(2), strict=True)))


def test_gate_rows_against_a_loop(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *[k / 10 for k in range(10)]]), r.choice([0, 1, None]), r.choice([None, r.gauss(0, 0.5)]), dt.date(2020, 1, 1) + dt.timedelta(r.randrange(900))) for _ in range(400)]
    df = spark.createDataFrame(rows, "score double, up int, gain double, date date")
    got = {x.threshold: x for x in cl.gate_rows(df, "score", "up", "gain", "date", (0.2, 0.5, 2.0), (0.1, 0.4)).collect()}
    positives, labelled = sum(u or 0 for _, u, *_ in rows), [u for _, u, *_ in rows if u is not None]
    for t in (0.2, 0.5):
        some = [x for x in rows if x[0] is not None and x[0] >= t]
        y, gain, days = [x[1] for x in some if x[1] is not None], [x[2] for x in some if x[2] is not None], [x[3] for x in some]
        g = got[t]
        assert g.n_pass == len(some) and g.coverage == pytest.approx(len(some) / 400) and g.precision == pytest.approx(sum(y) / len(y)) and g.recall == pytest.approx(sum(y) / positives)
        assert g.lift == pytest.approx(sum(y) / len(y) / (sum(labelled) / len(labelled))) and g.per_month == pytest.approx(len(some) / ((max(days) - min(days)).days / 30.4375))
        assert g.mean_outcome == pytest.approx(sum(gain) / len(gain)) and g.median_outcome == pytest.approx(statistics.median(gain), abs=1e-4) and g.p_over_2 == pytest.approx(sum(v > 0.4 for v in gain) / len(gain))
    assert (got[2.0].n_pass, got[2.0].per_month, got[2.0].precision, got[2.0].p_over_1) == (0, 0, None, None)
    years = {x.threshold: x for x in cl.gate_stability(df, "score", "up", "date", (0.5, 2.0)).collect()}
    by = [[x[1] for x in rows if x[0] is not None and x[0] >= 0.5 and x[1] is not None and x[3].year == y] for y in (2020, 2021, 2022)]
    prec = [sum(v) / len(v) for v in by if v]
    assert list(years) == [0.5] and years[0.5].n_years == len(prec) and years[0.5].variance == pytest.approx(statistics.variance(prec)) and years[0.5].range == pytest.approx(max(prec) - min(prec))
    assert cl.gate_rows(df.limit(0), "score", "up", "gain", "date", (0.2,), (0.1,)).select("n_pass", "coverage").first() == (0, None)
