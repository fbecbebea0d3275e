"""Macro and regime (M), fundamentals (E), data quality (C), text and JSON (X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import panel
from barsmith.operators import joins as j
from barsmith.operators import quality as q
from barsmith.operators import text as tx
from barsmith.plans.base import LINE, query, with_views
from barsmith.plans.features import rounded, rounded_sql
from barsmith.sources import tables as t

# A macro series has one row a day and no entity, so its windows are not partitioned.
def day_line():
    return Window.orderBy("date")


WIDE = """wide as (select date, max(case when symbol = '1-URGENT' then close end) as a, max(case when symbol = '2-HIGH' then close end) as b, max(case when symbol = '5-LOW' then close end) as x from macro group by date),
filled as (select date, last_value(a ignore nulls) over w as a, last_value(b ignore nulls) over w as b, last_value(x ignore nulls) over w as x from wide window w as (order by date rows between unbounded preceding and current row))"""


def filled(spark, sf_dir):
    m = t.macro(spark, sf_dir).groupBy("date").pivot("symbol", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("close"))
    run = day_line().rowsBetween(Window.unboundedPreceding, 0)
    return m.select("date", *[F.last(s, ignorenulls=True).over(run).alias(n) for s, n in (("1-URGENT", "a"), ("2-HIGH", "b"), ("5-LOW", "x"))])


@query("m1_m2_net_series", with_views("macro", more=WIDE, sql=f"select date, {rounded_sql('a / 1000 - b / 1000 - x')} as net from filled"))
def m1(spark, sf_dir):
    return filled(spark, sf_dir).select("date", rounded(F.col("a") / 1000 - F.col("b") / 1000 - F.col("x")).alias("net"))


PILLARS = f"""pillars as (select date, 50 + 50 * tanh(10 * (a / avg(a) over (order by date rows between 49 preceding and current row) - 1)) as trend,
  (25 * coalesce(least(greatest(1 - (b - 40000) / 120000, 0), 1), 1) + 25 * coalesce(least(greatest(1 - (x - 40000) / 120000, 0), 1), 1)) * 2 as risk from filled)"""


def pillars(spark, sf_dir):
    part = lambda x: 25 * F.coalesce(c.clip(1 - (F.col(x) - 40000) / 120000, 0.0, 1.0), F.lit(1.0))
    return filled(spark, sf_dir).select("date", (50 + 50 * F.tanh(10 * (F.col("a") / F.avg("a").over(day_line().rowsBetween(-49, 0)) - 1))).alias("trend"), ((part("b") + part("x")) * 2).alias("risk"))


@query("m4_m7_regime_score", with_views("macro", more=f"{WIDE},\n{PILLARS}", sql=f"select date, {rounded_sql('trend')} as trend, {rounded_sql('risk')} as risk, case when s >= 80 then 'strong' when s >= 60 then 'good' when s >= 40 then 'neutral' when s >= 20 then 'weak' else 'poor' end as category from (select *, 0.6 * trend + 0.4 * risk as s from pillars)"))
def m7(spark, sf_dir):
    label = c.threshold_label(0.6 * F.col("trend") + 0.4 * F.col("risk"), [(80, "strong"), (60, "good"), (40, "neutral"), (20, "weak")], "poor")
    return pillars(spark, sf_dir).select("date", rounded(F.col("trend")).alias("trend"), rounded(F.col("risk")).alias("risk"), label.alias("category"))


@query("m8_regime_deltas", with_views("macro", more=f"{WIDE},\n{PILLARS}", sql=f"select date, {rounded_sql('trend - lag(trend, 5) over (order by date)')} as delta_5, {rounded_sql('stddev_samp(trend) over (order by date rows between 9 preceding and current row)')} as vol_10 from pillars"))
def m8(spark, sf_dir):
    return pillars(spark, sf_dir).select("date", rounded(F.col("trend") - F.lag("trend", 5).over(day_line())).alias("delta_5"), rounded(F.stddev_samp("trend").over(day_line().rowsBetween(-9, 0))).alias("vol_10"))


FIRST = "over (order by date rows between unbounded preceding and 1 preceding)"


@query("m11_m14_expanding_z", with_views("macro", more=WIDE, sql=f"select date, {rounded_sql(f'(a - avg(a) {FIRST}) / nullif(stddev_samp(a) {FIRST}, 0)')} as z, cast(coalesce(abs((a - avg(a) {FIRST}) / nullif(stddev_samp(a) {FIRST}, 0)) >= 2, false) as int) as veto from filled"))
def m14(spark, sf_dir):
    e = day_line().rowsBetween(Window.unboundedPreceding, -1)
    z = (F.col("a") - F.avg("a").over(e)) / F.nullif(F.stddev_samp("a").over(e), F.lit(0.0))
    return filled(spark, sf_dir).select("date", rounded(z).alias("z"), F.coalesce(F.abs(z) >= 2, F.lit(False)).cast("int").alias("veto"))


@query("m16_above_average", with_views("bars", "bench", sql="select date, cast(spy_close > avg(spy_close) over (order by date rows between 199 preceding and current row) as int) as above from bench"))
def m16(spark, sf_dir):
    return t.benchmark_series(spark, sf_dir).select("date", (F.col("spy_close") > F.avg("spy_close").over(day_line().rowsBetween(-199, 0))).cast("int").alias("above"))


@query("m22_period_days", with_views("fundamentals", sql="select distinct ticker, cast(unnest(generate_series(cast(period_end as timestamp), cast(least(filing_date, period_end + 10) as timestamp), interval 1 day)) as date) as day from fundamentals"))
def m22(spark, sf_dir):
    return t.fundamentals(spark, sf_dir).select("ticker", F.explode(F.sequence("period_end", F.least("filing_date", F.date_add("period_end", 10)))).alias("day")).distinct()


QUARTERS = "over (partition by ticker order by period_end)"


@query("e4_growth_and_quality", with_views("fundamentals", sql=f"select ticker, period_end, {rounded_sql(f'(revenue - lag(revenue, 4) {QUARTERS}) / nullif(abs(lag(revenue, 4) {QUARTERS}), 0)')} as revenue_yoy, {rounded_sql('net_income / nullif(revenue, 0)')} as margin, {rounded_sql('net_income / nullif(total_equity, 0)')} as roe from fundamentals"))
def e4(spark, sf_dir):
    line = Window.partitionBy("ticker").orderBy("period_end")
    return t.fundamentals(spark, sf_dir).select("ticker", "period_end", rounded(c.abs_change_pct("revenue", 4, line) / 100).alias("revenue_yoy"), rounded(c.safe_ratio("net_income", "revenue")).alias("margin"), rounded(c.safe_ratio("net_income", "total_equity")).alias("roe"))


@query("e1_fact_resolution", with_views("fundamentals", sql="select ticker, period_end, arg_max(revenue, (filing_date, revenue)) as revenue from (select ticker, cast(date_trunc('year', period_end) as date) as period_end, filing_date, revenue from fundamentals) group by 1, 2"))
def e1(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir).select("ticker", F.trunc("period_end", "year").alias("period_end"), "filing_date", "revenue")
    return j.latest_per_key(f, ["ticker", "period_end"], [F.desc("filing_date"), F.desc("revenue")]).select("ticker", "period_end", "revenue")


@query("e3_announcement_dates", with_views("bars", "fundamentals", sql="select f.ticker, f.period_end, min(b.date) as announced from fundamentals f left join bars b on b.ticker = f.ticker and b.date > f.period_end and b.date <= f.period_end + 90 group by 1, 2"))
def e3(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("bar"))
    return j.next_event(t.fundamentals(spark, sf_dir).select("ticker", "period_end"), b, "ticker", "period_end", "bar", 90).select("ticker", "period_end", F.col("next_date").alias("announced"))


@query("e5_valuation", with_views("bars", "fundamentals", "shares", sql=f"""select f.ticker, f.period_end, {rounded_sql('case when net_income > 0 then b.close * s.shares_outstanding / net_income end')} as pe, {rounded_sql('case when total_equity > 0 then b.close * s.shares_outstanding / total_equity end')} as pb
from fundamentals f asof left join bars b on b.ticker = f.ticker and f.filing_date >= b.date left join shares s on s.ticker = f.ticker and s.date = f.period_end"""))
def e5(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("bar"), "close")
    d = j.asof(t.fundamentals(spark, sf_dir), b, "ticker", "filing_date", "bar", ["close"])
    d = d.join(t.shares(spark, sf_dir).withColumnRenamed("date", "period_end"), ["ticker", "period_end"], "left")
    cap = F.col("close") * F.col("shares_outstanding")
    over = lambda x: rounded(F.when(F.col(x) > 0, cap / F.col(x)))
    return d.select("ticker", "period_end", over("net_income").alias("pe"), over("total_equity").alias("pb"))


@query("e9_stale_tickers", with_views("bars", sql="select distinct ticker from bars where date >= date '1999-05-17' and date < date '1999-07-01' and ticker not in (select ticker from bars where date = date '1999-07-01')"))
def e9(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", "date")
    return b.where("date >= '1999-05-17' and date < '1999-07-01'").join(b.where("date = '1999-07-01'"), "ticker", "left_anti").select("ticker").distinct()


@query("c1_c2_coverage_freshness", with_views("bars", sql=f"select 'zero_volume' as check_name, case when v > 5 then 'FAIL' when v > 0 then 'WARN' else 'PASS' end as status, v as value, '' as detail from (select cast(count(*) filter (where volume = 0) as double) as v from bars) union all select 'stale', case when v > 60 then 'FAIL' when v > 10 then 'WARN' else 'PASS' end, v, d from (select cast(count(*) filter (where last < m - 60) as double) as v, cast(max(m) as varchar) as d from (select ticker, max(date) as last, max(max(date)) over () as m from bars group by ticker))"))
def c1(spark, sf_dir):
    b = t.bars(spark, sf_dir)
    last = b.groupBy("ticker").agg(F.max("date").alias("last")).withColumn("m", F.max("last").over(Window.partitionBy(F.lit(1))))
    zero = q.verdict(b, "zero_volume", F.count_if(F.col("volume") == 0), 0, 5)
    return zero.unionByName(q.verdict(last, "stale", F.count_if(F.col("last") < F.date_sub("m", 60)), 10, 60, F.max("m")))


@query("c3_null_shares", with_views("bars", sql="select 'prev' as column_name, round(avg(cast(prev is null as double)), 6) as null_share from (select lag(close, 20) " + LINE + " as prev from bars) union all select 'close', round(avg(cast(close is null as double)), 6) from bars"))
def c3(spark, sf_dir):
    d = t.bars(spark, sf_dir).select(F.lag("close", 20).over(panel()).alias("prev"), "close")
    return q.null_shares(d, ["prev", "close"]).select("column_name", F.round("null_share", 6).alias("null_share"))


@query("c5_duplicates", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def c5(spark, sf_dir):
    return q.duplicates(t.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("c7_ohlc_bands", with_views("bars", sql="select case when gap > 5 then 'severe' when gap > 0.5 then 'moderate' when gap > 0 then 'slight' else 'none' end as severity, count(*) as n from (select greatest(low - least(open, close), greatest(open, close) - high, 0) / close * 100 as gap from bars) group by 1"))
def c7(spark, sf_dir):
    return q.ohlc_violations(t.bars(spark, sf_dir))


@query("c8_extreme_moves", with_views("bars", sql=f"select ticker, date, {rounded_sql('move')} as move from (select *, close / lag(close) {LINE} - 1 as move from bars) where abs(move) > 2"))
def c8(spark, sf_dir):
    return q.extreme_moves(t.bars(spark, sf_dir), 2).select("ticker", "date", rounded(F.col("move")).alias("move"))


@query("c9_gap_entities", with_views("bars", sql="select ticker, have, expected from (select s.ticker, s.have, count(*) as expected from (select ticker, min(date) as lo, max(date) as hi, count(*) as have from bars group by ticker) s join (select distinct date from bars) d on d.date between s.lo and s.hi group by 1, 2) where have < 0.22 * expected"))
def c9(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", "date")
    return q.gap_entities(b, b, 0.22)


@query("c10_missing_days", with_views("bars", sql="select distinct cast(o_orderdate as date) as date from orders where cast(o_orderdate as date) between (select min(date) from bars) and (select max(date) from bars) and cast(o_orderdate as date) not in (select date from bars)"))
def c10(spark, sf_dir):
    return q.missing_days(t.bars(spark, sf_dir), t.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")))


@query("c4_scale_outliers", with_views("bars", sql="select b.ticker, b.date, b.close from bars b join (select ticker, median(close) as m from bars group by ticker) using (ticker) where close > 10 * m"))
def c4(spark, sf_dir):
    return q.scale_outliers(t.bars(spark, sf_dir).select("ticker", "date", "close"), "ticker", "close", 10)


@query("c26_run_health", f"select event_type as phase, count(*) as runs, {rounded_sql('avg(value)')} as mean, {rounded_sql('arg_max(value, (ts, event_id))')} as last, arg_max(value, (ts, event_id)) > 2 * avg(value) as slow from events group by 1")
def c26(spark, sf_dir):
    return q.run_health(t.run_log(spark, sf_dir)).select("phase", "runs", rounded(F.col("mean")).alias("mean"), rounded(F.col("last")).alias("last"), "slow")


@query("k7_json_fields", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def k7(spark, sf_dir):
    return t.run_log(spark, sf_dir).select("event_id", F.get_json_object("metadata", "$.k").cast("long").alias("k"))


@query("l7_fingerprint", "select event_type as phase, sha256(event_type || '|' || cast(count(*) as varchar)) as print from events group by 1")
def l7(spark, sf_dir):
    return t.run_log(spark, sf_dir).groupBy("phase").agg(F.count(F.lit(1)).alias("n")).select("phase", F.sha2(F.concat_ws("|", "phase", F.col("n").cast("string")), 256).alias("print"))


NORMAL = "trim(regexp_replace(lower(translate({x}, '‘’“”–—…', '''''\"\"--.')), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"


@query("x2_normalise", f"select doc_id, md5({NORMAL.format(x='text')}) as digest from documents")
def x2(spark, sf_dir):
    return t.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(tx.normalise(F.col("text")).cast("binary")).alias("digest"))


@query("x8_sections", "select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles from conversations group by conv_id")
def x8(spark, sf_dir):
    d = t.table(spark, sf_dir, "conversations", "conv_id", "turn", "role").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return d.select("conv_id", "turns", F.array_join(F.transform("x", lambda v: v["role"]), ">").alias("roles"))
