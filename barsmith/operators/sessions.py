"""Sessions: membership logs, trade sessions, trend runs, droughts (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.columns import panel
from barsmith.operators.writes import reread


def running():
    return panel().rowsBetween(Window.unboundedPreceding, 0)


def membership_log(days: DataFrame, passes: Column, grace: int) -> DataFrame:
    """ticker, effective_date, is_active: entry at the first pass (also after an exit), exit at the grace-th
    consecutive fail after a pass."""
    d = days.select("ticker", "date", passes.cast("int").alias("ok"))
    d = d.withColumn("island", F.sum("ok").over(running()))
    fails = Window.partitionBy("ticker", "island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("streak", F.sum(1 - F.col("ok")).over(fails))
    exits = (F.col("island") > 0) & (F.col("ok") == 0) & (F.col("streak") == grace)
    events = d.where(exits | (F.col("ok") == 1)).select("ticker", "date", (F.col("ok") == 1).alias("is_active"))
    previous = F.lag("is_active").over(panel())
    return events.withColumn("p", previous).where(F.col("p").isNull() & F.col("is_active") | (F.col("p") != F.col("is_active"))).select("ticker", F.col("date").alias("effective_date"), "is_active")


def membership_delta(state: DataFrame, day: DataFrame) -> DataFrame:
    """New log rows of one day: day (ticker, date, is_active) where it differs from the last state of the ticker."""
    last = state.groupBy("ticker").agg(F.max_by("is_active", "effective_date").alias("was"))
    joined = day.join(last, "ticker", "left")
    return joined.where(F.coalesce("was", F.lit(False)) != F.col("is_active")).select("ticker", F.col("date").alias("effective_date"), "is_active")


def active_on(log: DataFrame, on: Column) -> DataFrame:
    """Tickers that are active as of a day."""
    return log.where(F.col("effective_date") <= on).groupBy("ticker").agg(F.max_by("is_active", "effective_date").alias("a")).where("a").select("ticker")


def trade_sessions(days: DataFrame, hold: Column, signal: Column, closes: bool = False) -> DataFrame:
    """ticker, session_id, entry_date, exit_date, last_hold: maximal runs of hold with a signal inside; entry at
    the first signal, exit at the bar after the run (null if it is open). closes: also entry_close and exit_close, so that returns need
    no join with the bars."""
    d = days.select("ticker", "date", *(["close"] if closes else []), F.coalesce(hold, F.lit(False)).alias("h"), F.coalesce(signal, F.lit(False)).alias("s"))
    start = F.col("h") & ~F.coalesce(F.lag("h").over(panel()), F.lit(False))
    prices = [F.min_by("close", F.when(F.col("s"), F.col("date"))).alias("entry_close"), F.max_by("next_close", "date").alias("exit_close")] if closes else []
    d = d.withColumn("next_close", F.lead("close").over(panel())) if closes else d
    d = d.withColumn("next_date", F.lead("date").over(panel())).withColumn("run", F.sum(start.cast("int")).over(running())).where("h")
    runs = d.groupBy("ticker", "run").agg(F.min(F.when(F.col("s"), F.col("date"))).alias("entry_date"), F.max("date").alias("last_hold"), F.max_by("next_date", "date").alias("exit_date"), *prices).where("entry_date is not null")
    number = F.row_number().over(Window.partitionBy("ticker").orderBy("entry_date"))
    return runs.select("ticker", number.alias("session_id"), "entry_date", "exit_date", "last_hold", *(["entry_close", "exit_close"] if closes else []))


def sessions_and_day(days: DataFrame, hold: Column, signal: Column, end: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions (ticker, entry_date, exit_date, as trade_sessions() tells them) and the last day's rows (ticker, date, hold, signal), from
    one pass over the days: a row for each run of days that hold, or do not, which is written once. end: one row, the last day."""
    d = days.select("ticker", "date", F.coalesce(hold, F.lit(False)).alias("h"), F.coalesce(signal, F.lit(False)).alias("s"))
    start = F.col("h") & ~F.coalesce(F.lag("h").over(panel()), F.lit(False))
    d = d.withColumns({"next_date": F.lead("date").over(panel()), "start": start.cast("int")}).withColumn("run", F.sum("start").over(running()))
    last = F.col("date") == F.col("end")
    runs = d.join(F.broadcast(end)).groupBy("ticker", "run", "h").agg(
        F.min(F.when(F.col("s"), F.col("date"))).alias("entry_date"), F.max_by("next_date", "date").alias("exit_date"),
        F.max(F.when(last, F.col("date"))).alias("date"), F.max(F.when(last, F.col("s"))).alias("signal"))
    runs = reread(runs.where("h and entry_date is not null or date is not null"), "runs")
    sessions = runs.where("h and entry_date is not null").select("ticker", "entry_date", "exit_date")
    return sessions, runs.where("date is not null").select("ticker", "date", F.col("h").alias("hold"), "signal")


def step_sessions(state: DataFrame, day: DataFrame) -> DataFrame:
    """Sessions after one more day: state (ticker, entry_date, exit_date), day (ticker, date, hold, signal).

    Open sessions that no longer hold are closed at the day; tickers without an open session and with
    hold and signal get a new one. A pure function, so it serves batches and foreachBatch alike."""
    open_ = state.where("exit_date is null")
    closed = open_.join(day, "ticker", "left").select("ticker", "entry_date", F.when(F.col("hold") == F.lit(False), F.col("date")).alias("exit_date"))
    new = day.where("hold and signal").join(open_.select("ticker"), "ticker", "left_anti").select("ticker", F.col("date").alias("entry_date"), F.lit(None).cast("date").alias("exit_date"))
    return state.where("exit_date is not null").unionByName(closed).unionByName(new)


def retriggers(sessions: DataFrame, days: int = 14) -> DataFrame:
    """sessions with retrigger: entered at most `days` after the ticker's previous exit."""
    gap = F.date_diff("entry_date", F.lag("exit_date").over(Window.partitionBy("ticker").orderBy("entry_date")))
    return sessions.withColumn("retrigger", F.coalesce(gap <= days, F.lit(False)))


def current_runs(days: DataFrame, trend: Column) -> DataFrame:
    """ticker, start_date, start_close, length of the run of trend days that reaches the last day of the table."""
    d = days.select("ticker", "date", "close", F.coalesce(trend, F.lit(False)).alias("t"))
    d = d.withColumn("island", F.sum((~F.col("t")).cast("int")).over(running())).where("t")
    runs = d.groupBy("ticker", "island").agg(F.min("date").alias("start_date"), F.min_by("close", "date").alias("start_close"), F.count(F.lit(1)).alias("length"), F.max("date").alias("end_date"))
    last = days.groupBy("ticker").agg(F.max("date").alias("end_date"))
    return runs.join(last, ["ticker", "end_date"]).select("ticker", "start_date", "start_close", "length")


def drought(counts: DataFrame) -> DataFrame:
    """One row, drought_days: calendar days without counts (date, n) backwards from the last day of the series."""
    return counts.agg(F.date_diff(F.max("date"), F.max(F.when(F.col("n") > 0, F.col("date")))).alias("drought_days"))


def outcomes(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Per trade (ticker, session_id, entry_date, exit_date): return, MFE, MAE (entry day left out), their dates,
    holding days and observed days. Equi-join by ticker with the span as a condition."""
    span = (bars["ticker"] == trades["ticker"]) & (bars["date"] >= trades["entry_date"]) & (trades["exit_date"].isNull() | (bars["date"] <= trades["exit_date"]))
    d = trades.join(bars.select("ticker", "date", "high", "low", "close"), span).drop(bars["ticker"])
    after = F.col("date") > F.col("entry_date")
    agg = d.groupBy("ticker", "session_id", "entry_date", "exit_date").agg(
        F.min_by("close", "date").alias("entry_close"), F.max_by("close", "date").alias("last_close"), F.max("high").alias("top"), F.min(F.when(after, F.col("low"))).alias("bottom"),
        F.min(F.struct(-F.col("high"), "date"))["date"].alias("mfe_date"), F.min(F.when(after, F.struct("low", "date")))["date"].alias("mae_date"),
        F.max("date").alias("last_date"), F.count(F.lit(1)).alias("days_observed"))
    return agg.select(
        "ticker", "session_id", "entry_date", "exit_date", (F.col("last_close") / F.col("entry_close") - 1).alias("return_pct"), (F.col("top") / F.col("entry_close") - 1).alias("mfe"),
        (F.col("bottom") / F.col("entry_close") - 1).alias("mae"), "mfe_date", "mae_date", F.date_diff("last_date", "entry_date").alias("holding_days"), "days_observed")
