"""Operators on small hand-made frames, and the streaming forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.operators import joins, quality, sessions, stats, text, trades, writes
from barsmith.streaming import incremental


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=k)


def line(spark, values, ticker="A"):
    return spark.createDataFrame([(ticker, day(k), v) for k, v in enumerate(values)], "ticker string, date date, close double")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "date").collect()]


def test_rolling_primitives(spark):
    d = line(spark, [1.0, 3.0, 2.0, 3.0, None, 5.0])
    assert column(d.withColumn("x", c.ts_argmax("close", 3)), "x") == [None, None, 2, 1, None, None]
    assert column(d.withColumn("x", c.ts_rank("close", 3)), "x")[2:4] == [pytest.approx(2 / 3), pytest.approx(2.5 / 3)]
    assert column(d.withColumn("x", c.ts_sum("close", 2)), "x") == [None, 4.0, 5.0, 5.0, None, None]
    assert column(d.withColumn("x", c.decay_linear("close", 2)), "x")[1] == pytest.approx(7 / 3)
    assert column(d.withColumn("x", c.last_known("close")), "x")[4] == 3.0
    assert column(line(spark, [0.0, 0.0, 5.0, 0.0]).withColumn("x", c.zero_aware_change_pct("close")), "x") == [None, 0.0, 100.0, -100.0]
    assert column(line(spark, [2.0, 2.0, 2.0]).withColumn("x", c.ts_corr("close", "close", 3)), "x")[2] is None


def test_asof_ties_and_missing(spark):
    left = spark.createDataFrame([("A", 5), ("A", 1), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 3, 1), ("A", 3, 2), ("A", 9, 3)], "k string, t2 int, v int")
    back = {(r.k, r.t): r.v for r in joins.asof(left, right, "k", "t", "t2", ["v"]).collect()}
    assert back == {("A", 5): 2, ("A", 1): None, ("B", 5): None}
    ahead = {(r.k, r.t): r.v for r in joins.asof(left, right, "k", "t", "t2", ["v"], forward=True).collect()}
    assert ahead == {("A", 5): 3, ("A", 1): 2, ("B", 5): None}


def test_membership_grace(spark):
    d = line(spark, [0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0])
    log = sessions.membership_log(d, F.col("close") > 0, 3).orderBy("effective_date").collect()
    assert [(r.effective_date, r.is_active) for r in log] == [(day(1), True), (day(7), False)]


def test_sessions_open_and_closed(spark):
    d = line(spark, [0.0, 2.0, 3.0, 0.0, 2.0, 1.0, 3.0])
    got = sessions.trade_sessions(d, F.col("close") > 0, F.col("close") > 2).orderBy("session_id").collect()
    assert [(r.entry_date, r.exit_date) for r in got] == [(day(2), day(3)), (day(6), None)]


def test_exits_and_capacity(spark):
    bars = spark.createDataFrame([("A", day(k), o, low, x) for k, (o, low, x) in enumerate([(10.0, 10.0, 10.0), (10.0, 9.9, 11.0), (8.0, 7.0, 8.0)])], "ticker string, date date, open double, low double, close double")
    e = spark.createDataFrame([("A", day(0))], "ticker string, entry_date date")
    x = trades.label_exits(e, bars, 0.1, 0.5, 30).first()
    assert (x.reason, x.exit_date, x.exit_price) == ("stop", day(2), 8.0)
    book = spark.createDataFrame([(1, f"T{k}", day(k), day(k + 10)) for k in range(4)], "book_id int, ticker string, entry_date date, exit_date date")
    assert [r.admitted for r in trades.admit(book, 2).orderBy("ticker").collect()] == [True, True, False, False]


def test_perfect_and_useless_scores(spark):
    d = spark.createDataFrame([(f"T{k}", day(n), float(k), float(k * k), int(k > 5)) for n in range(3) for k in range(10)], "ticker string, date date, score double, out double, up int")
    assert all(r.ic == pytest.approx(1) for r in stats.daily_ic(d, "score", "out").collect())
    assert stats.roc_auc(d, "score", "up").first().auc == 1 and stats.average_precision(d, "score", "up").first().average_precision == 1
    assert stats.stability_index(d, d, "score").first().psi == pytest.approx(0)
    assert stats.best_threshold(d, "score", "up").first().threshold == 6.0


def test_write_modes(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(writes.insert_or_ignore(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(writes.insert_or_replace(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(writes.write_back(old, new, ["k"], ["v"])) == [(1, "a"), (2, "c")]


def test_text_jobs(spark):
    d = spark.createDataFrame([("The quick brown fox ... jumps over the dog", "“The  quick brown fox” often\njumps over the dog.", "Foo Bar Holdings, Inc. (NYSE)", "x\nRisks\na b\nSummary\nc")], "q string, doc string, name string, report string")
    r = d.select(text.grounded(text.normalise(F.col("q")), text.normalise(F.col("doc"))).alias("g"), text.canonical_key(F.col("name")).alias("k")).first()
    assert r.g and r.k == "foo-bar"
    assert [(x.heading, x.body) for x in text.sections(d.select("report"), "report", ["Risks", "Summary"]).collect()] == [("Risks", "a b"), ("Summary", "c")]
    close = spark.createDataFrame([("x\nRisks\nSummary\nc\nRisks",)], "report string")
    assert [(x.heading, x.body) for x in text.sections(close, "report", ["Risks", "Summary"]).collect()] == [("Risks", ""), ("Summary", "c"), ("Risks", "")]


def test_exact_quantiles_without_all_values_in_one_place(spark):
    from barsmith.operators.series import exact_quantiles

    rng = np.random.default_rng(5)
    rows = [(float(a), None if k % 9 == 0 else float(b), 1.0, None) for k, (a, b) in enumerate(zip(rng.normal(size=3000), rng.integers(0, 4, 3000), strict=True))]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    names, qs = ["a", "b", "c", "d"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(d, names, qs, accuracy=200, margin=3)
    want = d.agg(*[F.percentile(n, qs).alias(n) for n in names]).first()
    assert all(got.first()[n] is None if want[n] is None else got.first()[n] == pytest.approx(want[n], abs=1e-12) for n in names)
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert exact_quantiles(d.limit(0), names, qs).first()["a"] is None
    assert exact_quantiles(d.limit(1), ["a"], [0.5]).first()["a"] is not None


def test_day_rank_sorts_once(spark):
    from barsmith.functions.columns import day_rank

    d = spark.createDataFrame([(1, x) for x in (2.0, 2.0, None, 1.0, float("nan"), float("nan"), -0.0, 0.0)], "date int, x double")
    got = d.select("x", day_rank("x").alias("r"))
    place = {str(r.x): r.r for r in got.collect()}
    assert place == {"2.0": 4.5 / 7, "None": None, "1.0": 3 / 7, "nan": 6.5 / 7, "-0.0": 1.5 / 7, "0.0": 1.5 / 7}
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1


def test_short_quotes_are_grounded(spark):
    d = spark.createDataFrame([("oh. yes.", "Oh.  Yes.", True), ("yes... no...", "yes... no... well", True), ("no way", "yes", False), ("", "", True), ("λόγος", "λόγοςα", True)], "q string, doc string, want boolean")
    assert all(r.got == r.want for r in d.select("want", text.grounded(text.normalise(F.col("q")), text.normalise(F.col("doc"))).alias("got")).collect())


def test_fidelity_of_short_and_repeated_turns(spark, duck, tmp_path):
    from barsmith.plans import registry

    rows = [(1, 0, "user", "Yes."), (1, 0, "user", "Yes."), (1, 1, "assistant", "No."), (1, 2, "user", ""), (2, 4, "user", "a... b... c"), (2, 6, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duck.cursor()
    con.execute(f"create temp view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL["x4_fidelity"]).fetchall()
    assert sorted(map(tuple, registry.QUERIES["x4_fidelity"](spark, str(tmp_path)).collect())) == sorted(want)


def test_quality_verdicts(spark):
    d = line(spark, [1.0, -1.0, None])
    assert quality.verdict(d, "bad", F.count_if(F.col("close") <= 0), 0, 5).first().status == "WARN"
    assert {r.column_name: r.null_share for r in quality.null_shares(d, ["close"]).collect()} == {"close": pytest.approx(1 / 3)}


def test_streams(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, m), "x") for m in (0, 0, 30, 59)]
    spark.createDataFrame(rows, "ts timestamp, k string").write.parquet(f"{tmp_path}/events")
    events = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/events")
    for df, name, mode in ((incremental.window_counts(events, "ts", "k", "1 hour", "2 hours"), "counted", "complete"), (incremental.first_writes(events, ["ts", "k"], "ts", "2 hours"), "first", "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("counted").first().n == 4 and spark.table("first").count() == 3


def test_tickers_keep_long_keys(spark, tmp_path):
    from barsmith.sources import tables

    keys = [7, 10000, 99999, 100000, 100009, 1234567890123]
    at = dt.datetime(1995, 2, 3)
    spark.createDataFrame([(1, 1, 1, k, 2.0, 10.0, 0.0, 0.0, "R", at) for k in keys], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 0, 5.0) for k in keys], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, 0, "N")], "n_nationkey long, n_regionkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    want = sorted(["S00007", "S10000", "S99999", "S100000", "S100009", "S1234567890123"])
    for view in (tables.bars, tables.profiles, tables.fundamentals, tables.shares, tables.scores, tables.fills):
        assert sorted(r["ticker"] for r in view(spark, str(tmp_path)).select("ticker").collect()) == want
    assert tables.scores(spark, str(tmp_path)).where("score is null").count() == 0


def test_rolled_and_swings_of_many_short_and_long_lines(spark):
    import datetime as dt
    import math
    import random

    import numpy as np
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from barsmith.operators import series as se
    from barsmith.operators import signals as sg

    r = random.Random(3)
    rows = [(f"T{k}", dt.date(2020, 1, 1) + dt.timedelta(d), None if r.random() < 0.05 else r.uniform(1, 9)) for k in range(300) for d in range(1 if k % 3 else 90)]
    r.shuffle(rows)
    df = spark.createDataFrame([(None, *x[1:]) if x[0] == "T0" else x for x in rows], "ticker string, date date, close double")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-6, 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = se.rolled(df, "ticker", "date", {"mean": ("close", "mean", 7), "top": ("close", "max", 7), "low": ("close", "min", 7)}, [3])
        want = se.ema(df, "ticker", "date", "close", [3]).select("ticker", "date", "close", F.avg("close").over(w), F.max("close").over(w), F.min("close").over(w), "ema_3")
        key = lambda x: (x[0] or "", x[1])
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
        lines = {}
        for x in sorted(got.collect(), key=key):
            lines.setdefault(x.ticker, []).append(x)
        for line in (x for x in lines.values() if all(y.close is not None for y in x[:9])):
            e = line[0].close
            for x in line[1:9]:
                e = x.close / 2 + e / 2
                assert math.isclose(x.ema_3, e)
        full = df.where("close is not null and ticker is not null").withColumn("rev", F.lit(2.0))
        kinds = {(x.ticker, x.date): x.swing for x in sg.swings(full, "close", "rev").collect()}
        for ticker in ("T3", "T4", "T297"):
            line = sorted((x for x in full.collect() if x.ticker == ticker), key=lambda x: x.date)
            assert [kinds[ticker, x.date] for x in line] == sg.swing_kinds(np.array([x.close for x in line]), np.full(len(line), 2.0)).tolist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ticker_features_are_exchanged_once_and_called_by_batch(spark):
    from barsmith.plans import registry

    for name, exchanges in (("v1_screener_features", 2), ("g12_trend_segments", 1)):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and plan.count("Exchange hashpartitioning") == exchanges


def test_days_and_tickers_are_dealt_to_more_tasks_as_the_table_grows(spark, monkeypatch):
    from barsmith.plans import registry
    from barsmith.sources import tables

    monkeypatch.setattr(tables, "SHARE", 500)  # of about 6,000 line items
    for name in ("t5_redundant_features", "t36_composite_baseline", "v1_screener_features"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
        assert len(dealt) == 2 and not any(", 4)" in line for line in dealt)
