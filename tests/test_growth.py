"""Work of queries that must grow no faster than the tables: what their plans read and how often."""

from __future__ import annotations

import re

import __spark_entry__

SF = "/root/testdata/sf0.001"


def plan(spark, name: str) -> str:
    return __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_a_curve_and_its_trades_are_made_once(spark, monkeypatch):
    from barsmith.plans import books

    made = []
    monkeypatch.setattr(books.k, "path_exits", lambda *a, f=books.k.path_exits: made.append(1) or f(*a))
    assert plan(spark, "b6_equity_metrics").count("l_suppkey") <= 8 and made == [1]  # what is left are the benchmark's days


def test_the_daily_step_passes_the_bars_once(spark):
    assert "Window" not in plan(spark, "g7_daily_step")


def test_sessions_and_the_last_day_come_from_one_pass(spark):
    from pyspark.sql import functions as F

    from barsmith.operators import sessions as s

    rows = [("a", d, h, g) for d, h, g in ((1, True, False), (2, True, True), (3, False, False), (4, True, True), (5, True, False))] + [("b", d, h, True) for d, h in ((3, False), (4, True), (5, False))] + [("c", 4, True, True)]
    d = spark.createDataFrame(rows, "ticker string, d int, h boolean, g boolean").withColumn("date", F.date_from_unix_date("d"))
    sessions, day = s.sessions_and_day(d, F.col("h"), F.col("g"), d.agg(F.max("date").alias("end")))
    want = s.trade_sessions(d, F.col("h"), F.col("g")).select("ticker", "entry_date", "exit_date")
    assert sorted(map(str, sessions.collect())) == sorted(map(str, want.collect())) and want.count() == 4
    assert sorted((r.ticker, r.hold, r.signal) for r in day.collect()) == [("a", True, False), ("b", False, True)]


def test_bootstrap_trades_are_made_once(spark):
    assert "l_suppkey" not in plan(spark, "t28_bootstrap_intervals")


def test_long_windows_of_labels_visit_no_row_again_and_again(spark):
    found = re.findall(r"RowFrame, (-\d+), currentrow|RowFrame, 1, (\d+)", plan(spark, "l3_label_panel"))  # lags have two equal ends
    frames = [abs(int(x)) for pair in found for x in pair if x]
    assert "MapInPandas" in plan(spark, "l3_label_panel") and max(frames) < 63


def test_rolls_of_the_next_rows(spark):
    from barsmith.operators import series as se

    x = {"a": [3.0, None, 1.0, 2.0], "b": [5.0], "c": [1.0, 4.0, 2.0]}
    d = spark.createDataFrame([(k, i, v) for k, line in x.items() for i, v in enumerate(line)], "k string, i int, close double")
    got = {(r.k, r.i): (r.hi, r.lo) for r in se.rolled(d, "k", "i", {"hi": ("close", "max", -2), "lo": ("close", "min", -2)}).collect()}
    some = lambda f, line: f(v for v in line if v is not None) if any(v is not None for v in line) else None
    assert got == {(k, i): (some(max, line[i + 1:i + 3]), some(min, line[i + 1:i + 3])) for k, line in x.items() for i in range(len(line))}


def test_drift_rows_are_made_once_and_no_task_holds_their_values(spark):
    assert not re.search(r"l_suppkey|percentile\(", plan(spark, "t25_drift_report"))


def test_a_quantile_between_equal_values_is_that_value(spark):
    from pyspark.sql import functions as F

    from barsmith.operators import series as se

    values = [k / 7 for k in range(1, 40)]
    shares = [k / 10 for k in range(1, 10)]
    for v in values:
        d = spark.range(14).select(F.lit(v).alias("x")).coalesce(1)
        assert se.exact_quantiles(d, ["x"], shares).first().x == [v] * 9
        if v > 3:
            break


def test_dense_deployment_exchanges_no_wide_rows(spark):
    text = __spark_entry__.queries()["v17_dense_deployment"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(date" not in text and text.count("REPARTITION_BY_NUM") == 1  # line items, by ticker


def test_the_few_rows_before_a_row(spark):
    from barsmith.operators import joins as j

    left = spark.createDataFrame([(k, t) for k in ("a", "b", "c") for t in (1, 3, 5, None)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 1.0), ("a", 3, 2.0), ("a", 0, None), ("a", None, 9.0), ("b", 4, 7.0), ("d", 1, 8.0)], "k string, at int, v double")
    got = {(r.k, r.t): r.v for r in j.asof_few(left, right, "k", "t", "at", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 3): 2.0, ("a", 5): 2.0, ("b", 5): 7.0} | {k: None for k in got if k not in (("a", 3), ("a", 5), ("b", 5))} and len(got) == 12
    known = left.where("t is not null"), right.where("at is not null")
    assert sorted(map(str, j.asof_few(*known, "k", "t", "at", ["v"]).collect())) == sorted(map(str, j.asof(*known, "k", "t", "at", ["v"]).collect()))
