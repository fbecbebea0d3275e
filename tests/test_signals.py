"""Signals, evidence, periods and cohort percentiles against plain computations."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.operators import quality as q
from barsmith.operators import signals as sg
from barsmith.operators import text as tx
from barsmith.operators import writes as wr

DAY = dt.date(2020, 1, 1)


def test_swings_of_a_zigzag(spark):
    path = [0.0, 1.0, 2.0, 1.8, 1.0, 0.5, 0.6, 2.5, 2.6]
    assert list(sg.swing_kinds(np.array(path), np.full(len(path), 0.9))) == [0, 0, 1, 0, 0, -1, 0, 0, 0]
    assert list(sg.swing_kinds(np.array([1.0]), np.array([0.1]))) == [0] and len(sg.swing_kinds(np.array([]), np.array([]))) == 0
    df = spark.createDataFrame([(k, DAY + dt.timedelta(i), x, 0.9) for k in "AB" for i, x in enumerate(path)], "ticker string, date date, x double, rev double")
    got = sg.swings(df, "x", "rev").where("swing <> 0").orderBy("ticker", "date").collect()
    assert [(r["ticker"], (r["date"] - DAY).days, r["swing"]) for r in got] == [("A", 2, 1), ("A", 5, -1), ("B", 2, 1), ("B", 5, -1)]


def test_newey_west(spark):
    rng = random.Random(3)
    x = [rng.gauss(0.1, 1) for _ in range(40)]
    m = sum(x) / 40
    e = [v - m for v in x]
    var = sum(v * v for v in e) / 40
    for k in range(1, 6):
        var += 2 * (1 - k / 6) * sum(e[i] * e[i - k] for i in range(k, 40)) / 40
    df = spark.createDataFrame([(0, x), (1, x[:6]), (2, [1.0] * 10), (3, []), (4, None)], "id int, x array<double>")
    got = {r["id"]: r["t"] for r in df.select("id", sg.newey_west_t(F.col("x")).alias("t")).collect()}
    assert got[0] == pytest.approx(m / math.sqrt(var / 40)) and [got[i] for i in (1, 2, 3, 4)] == [None] * 4


def test_cohort_percentile(spark):
    rng = random.Random(5)
    rows = [(f"T{k}", DAY + dt.timedelta(2 * i), float(rng.randrange(5))) for i in range(12) for k in range(4) if rng.random() < 0.8]
    days = sorted({d for _, d, _ in rows})
    got = sg.cohort_percentile(spark.createDataFrame(rows, "ticker string, date date, score double"), "score", 3).collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [s for _, d, s in rows if d in days[max(0, days.index(r["date"]) - 2) : days.index(r["date"]) + 1]]
        assert r["percentile"] == pytest.approx(sum(s <= r["score"] for s in seen) / len(seen))


def test_linear_score_and_names(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("inf"), 0.0), (float("nan"), 0.0), (None, 0.0)], "Mom double, b double")
    got = [r["p"] for r in df.select(sg.linear_score(df, {"MOM": 1.0, "B": -0.5}, 0.5).alias("p")).collect()]
    assert got[0] == pytest.approx(1 / (1 + math.exp(-0.5))) and got[1:] == [None] * 3
    with pytest.raises(KeyError):
        sg.linear_score(df, {"other": 1.0}, 0.0)
    assert sg.forbidden_names(["mom", "fwd_Return_5", "x"], ["return_"]) == ["fwd_Return_5"]


def test_evidence_at_any_depth(spark):
    e = {"quote": "q", "source": "s", "strength": "weak"}
    payload = json.dumps({"a": [{"evidence": e}, {"b": {"c": e | {"quote": None}}}], **e})
    df = spark.createDataFrame([(1, payload), (2, "not json"), (3, None), (4, ""), (5, "[]")], "run_id bigint, payload string")
    got = sorted((r["run_id"], r["path"], r["quote"]) for r in tx.evidence(df, "run_id", "payload").collect())
    assert got == [(1, "", "q"), (1, "a[0].evidence", "q"), (1, "a[1].b.c", None)]


def test_by_period_and_reread(spark):
    df = spark.createDataFrame([("A", DAY + dt.timedelta(i), float(i)) for i in range(100)], "ticker string, date date, close double")
    mean = lambda d: d.select("ticker", "date", F.avg("close").over(c.back(5)).alias("m"))
    want = mean(df).where("date between '2020-02-01' and '2020-02-10'").collect()
    assert sorted(wr.by_period(df, "date", "2020-02-01", "2020-02-10", 10, mean).collect()) == sorted(want) and len(want) == 10
    back = wr.reread(df.withColumn("ticker", F.lit("007")), "test", by="ticker")
    assert back.count() == 100 and {r["ticker"] for r in back.select("ticker").distinct().collect()} == {"007"}


def test_checks_of_missing_columns(spark):
    df = spark.createDataFrame([(1.0,), (None,), (120.0,)], "x double")
    r = q.feature_checks(df, {"x": (0.0, 100.0)}).collect()[0]
    assert (r["nulls"], r["lowest"], r["highest"], r["in_range"]) == (1, 1.0, 120.0, False)
    with pytest.raises(KeyError):
        q.feature_checks(df, {"y": (0.0, 1.0)})


def test_coverage_and_resolution(spark):
    from barsmith.plans import serving as sv

    days = spark.createDataFrame([("A", DAY, 1.0), ("A", DAY + dt.timedelta(1), 2.0)], "ticker string, date date, close double")
    assert sv.require_coverage(days, days) is days
    with pytest.raises(ValueError, match="2020-01-02"):
        sv.require_coverage(days, days.where("close < 2"))
    got = sv.resolved(days, ["close", "close_delta", "twice"], {"twice": F.col("close") * 2}).orderBy("date").collect()
    assert [(r["close"], r["close_delta"], r["twice"]) for r in got] == [(1.0, None, 2.0), (2.0, 1.0, 4.0)]
    with pytest.raises(KeyError):
        sv.resolved(days, ["nothing"], {})
