"""Scans: the driver's tables, and the panel views that are mapped onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table, with the named columns only (pruned in the scan)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Line items, or bars made of them, of a task that sorts them, about.
SHARE = 1 << 17


def parts(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as keep each one's share of the bars at any size: a task holds its rows once for every sort."""
    items = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), items // SHARE + 1)


def ticker(key: str = "l_suppkey"):
    """S and the key of at least 5 digits; lpad alone would cut longer ones."""
    digits = F.col(key).cast("string")
    return F.concat(F.lit("S"), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def bars(spark: SparkSession, sf_dir: str, lines: bool = False) -> DataFrame:
    """ticker, date, open, high, low, close, volume: one bar per supplier and ship date. lines: dealt out by ticker before
    they are made, so that windows of a ticker need no exchange more."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    k = F.col("l_orderkey") * 1000000000 + F.col("l_linenumber") * 100000000 + F.col("l_partkey")
    rows = rows.select(ticker().alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", k.alias("k"))
    rows = rows.repartition(parts(spark, sf_dir), "ticker") if lines else rows
    return rows.groupBy("ticker", "date").agg(
        F.round(F.min_by("p", "k"), 8).alias("open"), F.round(F.max("p"), 8).alias("high"), F.round(F.min("p"), 8).alias("low"),
        F.round(F.max_by("p", "k"), 8).alias("close"), F.sum("l_quantity").cast("long").alias("volume"))


BARS = """bars as (
  select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, cast(l_shipdate as date) as date,
    round(min_by(l_extendedprice / l_quantity, k), 8) as open, round(max(l_extendedprice / l_quantity), 8) as high,
    round(min(l_extendedprice / l_quantity), 8) as low, round(max_by(l_extendedprice / l_quantity, k), 8) as close, cast(sum(l_quantity) as bigint) as volume
  from (select *, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey as k from lineitem) group by 1, 2)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector, industry, is_active, market_cap: one row per supplier."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        ticker("s_suppkey").alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
        (F.col("s_acctbal") >= 0).alias("is_active"), (1e6 + F.col("s_acctbal") * 100).alias("market_cap"))


PROFILES = """profiles as (
  select 'S' || lpad(cast(s_suppkey as varchar), 5, '0') as ticker, r_name as sector, n_name as industry, s_acctbal >= 0 as is_active, 1e6 + s_acctbal * 100 as market_cap
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def benchmark_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, spy_close: the mean close of the day."""
    return bars(spark, sf_dir).groupBy("date").agg(F.round(F.avg("close"), 6).alias("spy_close"))


BENCH = "bench as (select date, round(avg(close), 6) as spy_close from bars group by date)"


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, period_end, filing_date, revenue, net_income, total_equity by supplier and quarter."""
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    quarter = F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate").cast("date"), 2))
    rows = rows.select(ticker().alias("ticker"), "l_suppkey", quarter.alias("period_end"), "l_extendedprice", "l_discount")
    return rows.groupBy("ticker", "l_suppkey", "period_end").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"),
        F.round(F.sum(F.col("l_extendedprice") * (0.1 - F.col("l_discount"))), 4).alias("net_income"),
        F.round(F.sum("l_extendedprice") * 2, 4).alias("total_equity"),
    ).select("ticker", "period_end", F.date_add("period_end", (30 + F.col("l_suppkey") % 30).cast("int")).alias("filing_date"), "revenue", "net_income", "total_equity")


FUNDAMENTALS = """fundamentals as (
  select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, period_end, cast(period_end + cast(30 + l_suppkey % 30 as int) as date) as filing_date,
    round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, round(sum(l_extendedprice * (0.1 - l_discount)), 4) as net_income, round(sum(l_extendedprice) * 2, 4) as total_equity
  from (select *, cast(last_day(date_trunc('quarter', l_shipdate) + interval 2 month) as date) as period_end from lineitem) group by l_suppkey, period_end)"""


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, shares_outstanding at quarter ends."""
    b = bars(spark, sf_dir)
    end = F.last_day(F.add_months(F.date_trunc("quarter", "date").cast("date"), 2))
    return b.groupBy("ticker", end.alias("date")).agg((F.sum("volume") * 1000).cast("long").alias("shares_outstanding"))


SHARES = """shares as (
  select ticker, cast(last_day(date_trunc('quarter', date) + interval 2 month) as date) as date, cast(sum(volume) * 1000 as bigint) as shares_outstanding from bars group by 1, 2)"""


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, symbol, close: mean order value by order date and priority (a long macro table)."""
    return table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority", "o_totalprice").groupBy(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol")).agg(F.round(F.avg("o_totalprice"), 6).alias("close"))


MACRO = "macro as (select cast(o_orderdate as date) as date, o_orderpriority as symbol, round(avg(o_totalprice), 6) as close from orders group by 1, 2)"


def scores(spark: SparkSession, sf_dir: str, lines: bool = False, *more: str) -> DataFrame:
    """ticker, date, close, score: a deterministic score for every bar; and more of the bar's columns."""
    b = bars(spark, sf_dir, lines)
    number = F.substring("ticker", 2, 19).cast("long")
    days = F.date_diff("date", F.lit("1995-01-01").cast("date")).cast("long")
    return b.select("ticker", "date", "close", *more, (((number * 7919 + days * 104729) % 10007) / 10007.0).alias("score"))


SCORES = """scores as (
  select ticker, date, close, ((cast(substr(ticker, 2) as bigint) * 7919 + date_diff('day', date '1995-01-01', date) * 104729) % 10007) / 10007.0 as score from bars)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, trade_date, side, quantity, price, fees: one fill per line item."""
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    return rows.select(
        ticker().alias("ticker"), F.to_date("l_shipdate").alias("trade_date"), F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_tax").alias("fees"))


FILLS = """fills as (
  select 'S' || lpad(cast(l_suppkey as varchar), 5, '0') as ticker, cast(l_shipdate as date) as trade_date, case when l_returnflag = 'R' then 'SELL' else 'BUY' end as side,
    l_quantity as quantity, l_extendedprice / l_quantity as price, l_tax as fees from lineitem)"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, phase, runtime_seconds, metadata: events as an operations log."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("phase"), F.col("value").alias("runtime_seconds"), F.col("props").alias("metadata"))
