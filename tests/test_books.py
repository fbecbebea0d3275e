"""Exits, admission and equity of trade books against plain loops over single bars and days."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from barsmith.operators import books as k
from barsmith.operators.trades import admit

RULES = k.Rules(stop=0.1, sma=5, nday=8, atr=4, atr_multiple=2.0, breakeven_at=0.08, trail=0.06, most_bars=20, add_at=0.05)
START = dt.date(2021, 1, 1)


def walk(seed, days=70):
    rng, price, out = random.Random(seed), 100.0, []
    for n in range(days):
        if rng.random() < 0.08:
            continue
        low_open = price * (1 + rng.gauss(0, 0.02))
        close = low_open * (1 + rng.gauss(0.002, 0.025))
        out.append((START + dt.timedelta(n), low_open, max(low_open, close) * (1 + abs(rng.gauss(0, 0.01))), min(low_open, close) * (1 - abs(rng.gauss(0, 0.01))), close))
        price = close
    return out


def brute_exit(line, at, policy):
    """date, price, reason of the trade entered at bar `at` of a ticker."""
    ranges = [h - lo if n == 0 else max(h - lo, abs(h - line[n - 1][4]), abs(lo - line[n - 1][4])) for n, (_, _, h, lo, _) in enumerate(line)]
    mean = lambda xs: sum(xs) / len(xs)
    entry = line[at][4]
    stop, top, raised = entry * (1 - RULES.stop), -math.inf, -math.inf
    for held, n in enumerate(range(at + 1, len(line)), 1):
        date, open_, high, low, close = line[n]
        top, atr = max(top, high), mean(ranges[max(0, n - RULES.atr + 1):n + 1])
        level = {"atr_trail": top - RULES.atr_multiple * atr, "breakeven": max(entry, top * (1 - RULES.trail)) if top >= entry * (1 + RULES.breakeven_at) else stop, "ratchet": max(stop, raised)}.get(policy, stop)
        if low <= level:
            return date, min(level, open_), "trail_stop" if policy == "ratchet" and raised > stop else "stop_loss"
        if policy == "sma" and close < mean([x[4] for x in line[max(0, n - RULES.sma + 1):n + 1]]):
            return date, close, "trend_break"
        if policy == "nday" and held >= RULES.nday:
            return date, close, "nday_exit"
        if held >= RULES.most_bars:
            return date, close, "max_hold"
        raised = max(raised, high - RULES.atr_multiple * atr)
    return line[-1][0], line[-1][4], "held_open"


@pytest.fixture(scope="module")
def book(spark):
    lines = {f"T{k}": walk(k) for k in range(40)}
    bars = spark.createDataFrame([(t, *row) for t, line in lines.items() for row in line], "ticker string, date date, open double, high double, low double, close double")
    chosen = [(t, line[n][0], random.Random(t + str(n)).random()) for t, line in lines.items() for n in (0, 3, 20, 21, len(line) - 4, len(line) - 1)]
    entries = spark.createDataFrame([*chosen, ("T1", dt.date(2030, 1, 1), 0.5), ("NONE", START, 0.5)], "ticker string, entry_date date, score double")
    trades = k.path_exits(entries, bars, RULES).cache()
    return lines, bars, chosen, trades


def test_every_policy_and_reason(book):
    lines, _, chosen, trades = book
    got = {(r.policy, r.ticker, r.entry_date): r for r in trades.collect()}
    assert len(got) == len(chosen) * len(k.POLICIES)
    for ticker, day, _ in chosen:
        line = lines[ticker]
        at = [x[0] for x in line].index(day)
        for policy in k.POLICIES:
            r = got[policy, ticker, day]
            date, price, reason = brute_exit(line, at, policy)
            assert (r.exit_date, r.reason) == (date, reason) and math.isclose(r.exit_price, price, rel_tol=1e-12)
            assert math.isclose(r.pnl_pct, price / line[at][4] - 1, abs_tol=1e-12) and r.holding_days == (date - day).days
            added = [x[0] for x in line[at + 1:at + 1 + RULES.most_bars] if x[2] >= line[at][4] * (1 + RULES.add_at)]
            assert r.add_date == (added[0] if added else None)
    assert {r.reason for r in got.values()} == {"stop_loss", "trend_break", "nday_exit", "trail_stop", "max_hold", "held_open"}


def weekday(d):
    return d + dt.timedelta({5: 2, 6: 1}.get(d.weekday(), 0))


@pytest.mark.parametrize("starter", [None, 0.5])
def test_equity_by_single_days(spark, book, starter):
    lines, bars, _, trades = book
    rows = [r for r in trades.where("policy = 'breakeven'").collect()]
    weights = [(START + dt.timedelta(n), w) for n, w in ((11, 0.5), (25, 1.25), (26, 0.0), (28, 1.0))]
    got = k.equity_curve(trades.where("policy = 'breakeven'"), bars, 0.1, starter, spark.createDataFrame(weights, "date date, weight double")).orderBy("date").collect()
    first, last = min(r.entry_date for r in rows), max(r.exit_date for r in rows)
    grid = [d for d in (first + dt.timedelta(n) for n in range((last - first).days + 1)) if d.weekday() < 5]
    earned, opened = dict.fromkeys(grid, 0.0), dict.fromkeys(grid, 0)
    for r in rows:
        begin, end = weekday(r.entry_date), weekday(r.exit_date)
        if end > grid[-1] or end <= begin:
            continue
        closes = {d: c for d, _, _, _, c in lines[r.ticker] if d.weekday() < 5 and first <= d <= last}
        for d in grid:
            opened[d] += begin <= d < end
            if begin < d <= end and d in closes and (before := [x for x in closes if x < d]):
                part = 1.0 if starter is None or (r.add_date and d >= weekday(r.add_date)) else starter
                earned[d] += part * (closes[d] / closes[max(before)] - 1)
    growth, weight = 1.0, 1.0
    assert [r.date for r in got] == grid and max(opened.values()) > 10
    for r in got:
        weight = dict(weights).get(r.date, weight)
        daily = earned[r.date] * 0.1 * (10 / opened[r.date] if opened[r.date] > 10 else 1) * weight
        growth *= 1 + daily
        assert r.open_trades == opened[r.date] and math.isclose(r.daily_return, daily, abs_tol=1e-12) and math.isclose(r.growth, growth, rel_tol=1e-9)
    m = k.curve_metrics(spark.createDataFrame(got)).first()
    tops = [max(x.growth for x in got[: n + 1]) for n in range(len(got))]
    assert math.isclose(m.max_drawdown, min(x.growth / y - 1 for x, y in zip(got, tops, strict=True)), rel_tol=1e-12)
    assert math.isclose(m.calmar, m.ann_return / -m.max_drawdown) and m.days == len(grid)


def test_gates(spark):
    rows = [("A", 1, 0.9), ("B", 1, 0.9), ("C", 1, 0.95), ("A", 2, 0.99), ("B", 2, 0.2), ("C", 2, 0.91), ("B", 3, 0.97), ("D", 3, 0.92), ("C", 4, 0.93), ("D", 4, 0.9)]
    scored = spark.createDataFrame([(t, START + dt.timedelta(d), s) for t, d, s in rows], "ticker string, date date, score double")
    found = lambda **x: {(r.ticker, (r.entry_date - START).days) for r in k.gated_entries(scored, 0.9, 2, **x).collect()}
    assert found() == {("C", 1), ("A", 1), ("B", 3), ("D", 3)}
    assert found(warmup=1) == {("A", 2), ("C", 2), ("B", 3), ("D", 3)}
    assert found(warmup=9) == set()
    shut = spark.createDataFrame([(START + dt.timedelta(3), 0.0), (START + dt.timedelta(4), 0.5)], "date date, weight double")
    assert found(warmup=1, exposure=shut) == {("A", 2), ("C", 2), ("D", 4)}


def test_slots_go_to_the_higher_score(spark):
    day = lambda n: START + dt.timedelta(n)
    rows = [(1, "A", day(0), day(5), 0.2), (1, "B", day(0), day(3), 0.9), (1, "C", day(0), day(9), 0.5), (1, "D", day(3), day(4), 0.1), (1, "E", day(3), day(9), 0.1)]
    df = spark.createDataFrame(rows, "book_id int, ticker string, entry_date date, exit_date date, score double")
    assert {r.ticker for r in admit(df, 2, "score").where("admitted").collect()} == {"B", "C", "D"}
    assert {r.ticker for r in admit(df, 2).where(F.col("admitted")).collect()} == {"A", "B", "D"}


def test_no_trades(spark, book):
    _, bars, _, trades = book
    assert k.equity_curve(trades.limit(0), bars, 0.1).count() == 0
    assert k.curve_metrics(k.equity_curve(trades.limit(0), bars, 0.1)).first().days == 0
