"""The screener table on odd inputs, and measures of regimes against plain loops."""

import datetime as dt
import random

import pytest

from barsmith.operators import regimes as rg
from barsmith.operators import screener as sc

DAY = dt.date(2024, 1, 1)


def bars_of(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume long")


def test_screener_of_short_histories_and_missing_profiles(spark):
    rows = [(k, DAY + dt.timedelta(i), 10.0, 12.0, 9.0, 10.0 + i * (k == "A"), 100) for k in "AB" for i in range(3)]
    bench = spark.createDataFrame([(DAY + dt.timedelta(i), 5.0) for i in range(2)], "date date, spy_close double")  # the third day is missing
    profiles = spark.createDataFrame([("A", "s", "i")], "ticker string, sector string, industry string")
    got = {(r.ticker, r.date): r for r in sc.screener_table(bars_of(spark, rows), bench, profiles).collect()}
    assert len(got) == 4
    r = got["A", DAY + dt.timedelta(1)]
    assert list(r.asDict()) == sc.COLUMNS and (r.sma_20, r.high_20d, r.price_vs_spy, r.rs, r.rs_universe_rank, r.trend_ok, r.breakout_ok) == (10.5, 10.0, 2.2, None, None, False, False)
    assert got["B", DAY].price_vs_spy_ma63 == 2.0 and not got["B", DAY].rs_line_uptrend
    assert sc.screener_table(bars_of(spark, []), bench, profiles).count() == 0


def test_day_columns_rank_only_bars_with_strength(spark):
    rows = [("a", 1.0, "s"), ("b", 2.0, "s"), ("c", 3.0, None), ("d", None, "s")]
    d = spark.createDataFrame([(t, DAY, rs, s, s) for t, rs, s in rows], "ticker string, date date, rs double, sector string, industry string")
    got = {r.ticker: r for r in sc.day_columns(d).collect()}
    assert [got[t].rs_universe_rank for t in "abcd"] == [0.0, 0.5, 1.0, None] and [got[t].rs_rating for t in "abcd"] == [1, 50, 99, None]
    assert got["c"].rs_vs_sector == 0 and got["a"].sector_momentum == 0.25 and got["d"].rs_vs_sector is None
    assert got["b"].rs_vs_sector == pytest.approx((2 - 0.25) / (0.125 ** 0.5))


def test_measures_of_regimes_against_loops(spark):
    r = random.Random(5)
    days, regime = [], "FLAT"
    for i in range(300):
        if r.random() < 0.1:
            regime = r.choice(["BEAR", "BULL", "FLAT", None])
        days.append((DAY + dt.timedelta(i), round({"BEAR": 42, "BULL": 60}.get(regime, 50) + r.gauss(0, 8)) * 1.0 if r.random() > 0.05 else None, regime))
    df = spark.createDataFrame(days, "date date, score double, regime string").repartition(5)

    want, run = [], None
    for date, score, g in [*days, (None, None, None)]:
        if g == "BEAR":
            run = run or [date, date, None]
            run[1] = date
            run[2] = run[2] or (date if score is not None and score < rg.SIGNAL else None)
        elif run:
            want.append((*run, run[2] is not None, ((run[2] or run[1]) - run[0]).days))
            run = None
    assert sorted(map(tuple, rg.reaction_lags(df).collect())) == sorted(want)

    known = [(s, g) for _, s, g in days if s is not None and g is not None]
    def auc(g):
        pairs = [(s > o) + 0.5 * (s == o) for s, x in known if x == g for o, y in known if y != g]
        return sum(pairs) / len(pairs)
    low, high = ([s for s, g in known if g == x] for x in ("BEAR", "BULL"))
    ks = max(abs(sum(x <= v for x in low) / len(low) - sum(x <= v for x in high) / len(high)) for v in low + high)
    got = rg.fitness(df).first()
    lag = sum(x[4] for x in want) / len(want)
    assert got.auc_low == pytest.approx(1 - auc("BEAR")) and got.auc_high == pytest.approx(auc("BULL")) and got.ks == pytest.approx(ks)
    assert got.avg_lag == pytest.approx(lag) and got.fitness == pytest.approx(0.6 * got.auc_low + 0.4 * got.auc_high - 0.01 * max(0, lag - 7))
    assert sum(x.n_days for x in rg.score_by_regime(df).collect()) == 300


def test_regimes_without_runs(spark):
    flat = spark.createDataFrame([(DAY, 1.0, "FLAT")], "date date, score double, regime string")
    assert rg.reaction_lags(flat).count() == 0 and rg.reaction_lags(flat.limit(0)).count() == 0
    assert rg.fitness(flat).select("n_periods", "avg_lag").first() == (0, None)


def test_wide_rows_are_exchanged_once(spark):
    """The table as shown: wide rows go to their day once; before, they went on by ticker for one rolled rank."""
    from barsmith.plans import registry

    plan = registry.QUERIES["v1_screener_table"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(date") < plan.index("hashpartitioning(ticker")  # a plan begins with its last step


def test_wide_rows_are_not_exchanged(spark):
    """What the day ranks and its ranks alone change their layout: before, rows with all columns went to their day."""
    import re

    from barsmith.plans import registry

    df = registry.QUERIES["v1_screener_table"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert len(df.columns) > 55 and max(map(int, re.findall(r"Exchange\nInput \[(\d+)\]", text))) <= 22


def test_columns_without_factors_of_ranked_windows_are_those_of_the_whole_table(spark):
    r = random.Random(3)
    rows = []
    for k in range(9):
        close = 50.0
        for i in range(290):
            close *= 1 + r.gauss(0.001 * (k - 4), 0.02)
            if r.random() > 0.03:
                rows.append((f"T{k}", DAY + dt.timedelta(i), close * 0.99, close * 1.01, close * 0.98, close, r.randrange(3) * 100))
    bench = spark.createDataFrame([(DAY + dt.timedelta(i), 5.0 + i % 7) for i in range(290) if i != 200], "date date, spy_close double")
    profiles = spark.createDataFrame([(f"T{k}", f"s{k % 2}", f"i{k % 3}") for k in range(8)], "ticker string, sector string, industry string")
    some = [n for n in sc.COLUMNS if n not in sc.AGAIN]
    key = lambda x: (x.ticker, x.date)
    want = sorted(sc.screener_table(bars_of(spark, rows), bench, profiles).select(*some).collect(), key=key)
    got = sorted(sc.screener_table(bars_of(spark, rows), bench, profiles, some, 5).collect(), key=key)
    assert len(got) == len(want) > 2000 and got[0].__fields__ == some
    same = lambda v, w: v == w or (isinstance(v, float) and isinstance(w, float) and abs(v - w) <= 1e-9 * max(1, abs(w)))
    assert [(x, n) for x, y in zip(got, want, strict=True) for n in some if not same(x[n], y[n])] == []
