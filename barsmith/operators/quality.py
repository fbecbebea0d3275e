"""Data-quality checks: every check is rows of (check_name, status, value, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.columns import panel


def verdict(df: DataFrame, name: str, value: Column, warn: float, fail: float, detail: Column | None = None) -> DataFrame:
    """One row: PASS up to warn, WARN up to fail, FAIL beyond."""
    v = df.agg(value.cast("double").alias("value"), (detail if detail is not None else F.lit("")).alias("detail"))
    status = F.when(F.col("value") > fail, "FAIL").when(F.col("value") > warn, "WARN").otherwise("PASS")
    return v.select(F.lit(name).alias("check_name"), status.alias("status"), "value", F.col("detail").cast("string").alias("detail"))


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, null_share of each column, in one pass."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column_name", "null_share")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(dimension.select(key), key, "left_anti")


def ohlc_violations(bars: DataFrame) -> DataFrame:
    """severity, n of bars whose open or close lies outside low and high, by how far in percent."""
    gap = F.greatest(F.col("low") - F.least("open", "close"), F.greatest("open", "close") - F.col("high"), F.lit(0.0)) / F.col("close") * 100
    band = F.when(gap > 5, "severe").when(gap > 0.5, "moderate").when(gap > 0, "slight").otherwise("none")
    return bars.groupBy(band.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def extreme_moves(bars: DataFrame, limit: float) -> DataFrame:
    """Bars whose close moved by more than `limit` (2 = 200 %)."""
    move = F.col("close") / F.lag("close").over(panel()) - 1
    return bars.withColumn("move", move).where(F.abs("move") > limit).select("ticker", "date", "move")


def gap_entities(bars: DataFrame, calendar: DataFrame, least: float) -> DataFrame:
    """ticker, have, expected where a ticker has less than `least` of the calendar days inside its own span."""
    days = calendar.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))  # one row a day
    spans = bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("have"))
    a, b = days.select(F.col("date").alias("lo"), F.col("k").alias("ka")), days.select(F.col("date").alias("hi"), F.col("k").alias("kb"))
    d = spans.join(a, "lo").join(b, "hi").withColumn("expected", F.col("kb") - F.col("ka") + 1)
    return d.where(F.col("have") < least * F.col("expected")).select("ticker", "have", "expected")


def missing_days(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar days without any bar between the panel's first and last."""
    span = bars.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    inside = calendar.join(F.broadcast(span), (calendar["date"] >= F.col("lo")) & (calendar["date"] <= F.col("hi")))  # one row
    return inside.select("date").distinct().join(bars.select("date").distinct(), "date", "left_anti")


def scale_outliers(df: DataFrame, key: str, x: str, times: float) -> DataFrame:
    """Rows whose x is over `times` the key's median."""
    medians = df.groupBy(key).agg(F.percentile(x, F.lit(0.5)).alias("median"))
    return df.join(medians, key).where(F.col(x) > times * F.col("median")).select(*df.columns)


def report_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Checks that fail now and did not fail before."""
    return current.where("status = 'FAIL'").join(previous.where("status = 'FAIL'").select("check_name"), "check_name", "left_anti")


def run_health(log: DataFrame) -> DataFrame:
    """phase, runs, mean and last runtime, and whether the last took over twice the mean."""
    d = log.groupBy("phase").agg(F.count(F.lit(1)).alias("runs"), F.avg("runtime_seconds").alias("mean"), F.max_by("runtime_seconds", F.struct("ts", "event_id")).alias("last"))
    return d.withColumn("slow", F.col("last") > 2 * F.col("mean"))


def purge_dates(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """The dates of df that the calendar does not have."""
    return df.select("date").distinct().join(calendar.select("date").distinct(), "date", "left_anti")


def feature_checks(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """feature, nulls, lowest, highest, in_range for each column that should be there, in one pass; a missing column is an error."""
    missing = [n for n in ranges if n not in df.columns]
    if missing:
        raise KeyError(", ".join(missing))
    parts = [
        F.struct(F.lit(n).alias("feature"), F.count_if(F.col(n).isNull()).alias("nulls"), F.min(n).alias("lowest"), F.max(n).alias("highest"), F.coalesce(F.bool_and(F.col(n).between(lo, hi)), F.lit(False)).alias("in_range"))
        for n, (lo, hi) in ranges.items()
    ]
    return df.agg(F.array(*parts).alias("f")).select(F.inline("f"))


def panel_gaps(panels: DataFrame, key: str, calendar: DataFrame) -> DataFrame:
    """key, missing, first_missing, last_missing: calendar days between a panel's first and last day without any row of it.

    Calendar days get numbers, one row a day; a panel's gaps are the jumps in the numbers of its own days. So no panel
    meets the calendar's every day, only its own."""
    number = F.row_number().over(Window.orderBy("date"))
    days = calendar.select("date").distinct().withColumn("n", number)  # one row a day
    mine = panels.select(key, "date").distinct().join(days, "date")
    line = Window.partitionBy(key).orderBy("n")
    jumps = mine.withColumns({"next": F.lead("n").over(line)}).where(F.col("next") > F.col("n") + 1)
    ends = jumps.groupBy(key).agg(F.sum(F.col("next") - F.col("n") - 1).alias("missing"), (F.min("n") + 1).alias("first_n"), (F.max("next") - 1).alias("last_n"))
    first, last = days.select(F.col("n").alias("first_n"), F.col("date").alias("first_missing")), days.select(F.col("n").alias("last_n"), F.col("date").alias("last_missing"))
    return ends.join(first, "first_n").join(last, "last_n").select(key, "missing", "first_missing", "last_missing")
