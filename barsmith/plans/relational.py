"""Sources and write modes (K), joins (J), aggregates (A), set operations (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import panel
from barsmith.operators import joins as j
from barsmith.operators import writes as w
from barsmith.plans.base import LINE, query, with_views
from barsmith.plans.features import FLAGGED, flagged, rounded, rounded_sql
from barsmith.sources import tables as t

CUT = "1998-06-30"


def old_new(spark, sf_dir):
    """Two versions of the bars: the older up to the cut, the newer from a year before it with other closes."""
    b = t.bars(spark, sf_dir).select("ticker", "date", "close", "volume")
    return b.where(F.col("date") <= CUT), b.where(F.col("date") > F.add_months(F.lit(CUT).cast("date"), -12)).withColumn("close", F.round(F.col("close") + 1, 8))


OLD_NEW = f"""old as (select ticker, date, close, volume from bars where date <= date '{CUT}'),
new as (select ticker, date, round(close + 1, 8) as close, volume from bars where date > date '1997-06-30')"""


@query("k1_pruned_scan", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 45")
def k1(spark, sf_dir):
    return t.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity >= 45")


@query("k3_range_with_warmup", with_views("bars", sql=f"select ticker, date, {rounded_sql('m')} as m from (select ticker, date, avg(close) over (partition by ticker order by date rows between 9 preceding and current row) as m from bars where date between date '1999-01-01' - 200 and date '1999-12-31') where date >= date '1999-01-01'"))
def k3(spark, sf_dir):
    b = t.bars(spark, sf_dir).where(F.col("date").between(F.date_sub(F.lit("1999-01-01").cast("date"), 200), F.lit("1999-12-31").cast("date")))
    return b.select("ticker", "date", rounded(F.avg("close").over(c.back(10))).alias("m")).where(F.col("date") >= "1999-01-01")


@query("k4_k8_insert_or_ignore", with_views("bars", more=OLD_NEW, sql="select * from old union all select * from new where not exists (select 1 from old where old.ticker = new.ticker and old.date = new.date)"))
def k8(spark, sf_dir):
    return w.insert_or_ignore(*old_new(spark, sf_dir), ["ticker", "date"])


@query("k11_insert_or_replace", with_views("bars", more=OLD_NEW, sql="select * from new union all select * from old where not exists (select 1 from new where old.ticker = new.ticker and old.date = new.date)"))
def k11(spark, sf_dir):
    return w.insert_or_replace(*old_new(spark, sf_dir), ["ticker", "date"])


@query("k9_upsert_by_source", with_views("bars", more=OLD_NEW, sql="""
select coalesce(o.ticker, n.ticker) as ticker, coalesce(o.date, n.date) as date, case when o.ticker is not null and (n.ticker is null or o.volume % 2 = 0) then o.close else n.close end as close
from old o full join new n on o.ticker = n.ticker and o.date = n.date"""))
def k9(spark, sf_dir):
    old, new = old_new(spark, sf_dir)
    source = F.when(F.col("volume") % 2 == 0, "first").otherwise("second")
    return w.upsert_by_source(old.withColumn("source", source), new.withColumn("source", F.lit("second")), ["ticker", "date"], "source", "first").select("ticker", "date", "close")


@query("k12_replace_range", with_views("bars", more=OLD_NEW, sql="select * from old where date not between date '1998-01-01' and date '1998-03-31' union all select * from new where date between date '1998-01-01' and date '1998-03-31'"))
def k12(spark, sf_dir):
    return w.replace_range(*old_new(spark, sf_dir), "date", F.lit("1998-01-01").cast("date"), F.lit("1998-03-31").cast("date"))


@query("k13_write_back", with_views("bars", more=OLD_NEW, sql="select o.ticker, o.date, coalesce(n.close, o.close) as close, o.volume from old o left join new n on o.ticker = n.ticker and o.date = n.date"))
def k13(spark, sf_dir):
    return w.write_back(*old_new(spark, sf_dir), ["ticker", "date"], ["close"])


@query("k5_unpivot", with_views("bars", sql="select ticker, date, 'open' as field, open as value from bars union all select ticker, date, 'close', close from bars"))
def k5(spark, sf_dir):
    return t.bars(spark, sf_dir).select("ticker", "date", "open", "close").unpivot(["ticker", "date"], ["open", "close"], "field", "value")


@query("k15_sliced_export", with_views("bars", "profiles", sql="select ticker, date, close from bars where date >= (select max(date) from bars) - 60 or ticker in (select ticker from profiles where sector = 'ASIA')"))
def k15(spark, sf_dir):
    return w.slice_window(t.bars(spark, sf_dir).select("ticker", "date", "close"), "date", 60, t.profiles(spark, sf_dir).where("sector = 'ASIA'"), "ticker")


@query("k16_replace_scope", with_views("bars", "profiles", sql="select ticker, sector, 0 as version from profiles where sector <> 'ASIA' union all select ticker, sector, 1 from profiles where sector = 'ASIA'"))
def k16(spark, sf_dir):
    p = t.profiles(spark, sf_dir).select("ticker", "sector")
    return w.replace_scope(p.withColumn("version", F.lit(0)), p.where("sector = 'ASIA'").withColumn("version", F.lit(1)), "sector", "ASIA")


@query("k20_relabel", with_views("bars", sql="""select 'S00001' as ticker, date, close from bars where ticker = 'S00002' union all
select ticker, date, close from bars b where ticker <> 'S00002' and not (ticker = 'S00001' and date in (select date from bars where ticker = 'S00002'))"""))
def k20(spark, sf_dir):
    return w.relabel(t.bars(spark, sf_dir).select("ticker", "date", "close"), "ticker", "date", "S00002", "S00001")


@query("k21_purge", with_views("bars", "profiles", sql="select ticker, date, close from bars where ticker not in (select ticker from profiles where not is_active)"))
def k21(spark, sf_dir):
    return w.purge(t.bars(spark, sf_dir).select("ticker", "date", "close"), t.profiles(spark, sf_dir).where("not is_active"), ["ticker"])


@query("j1_dimension_lookup", with_views("bars", "profiles", sql="select b.ticker, date, close, sector, industry from bars b join profiles using (ticker) where is_active"))
def j1(spark, sf_dir):
    return t.bars(spark, sf_dir).join(t.profiles(spark, sf_dir).where("is_active"), "ticker").select("ticker", "date", "close", "sector", "industry")


@query("j2_carry_forward", with_views("bars", "scores", sql="select b.ticker, b.date, b.close, s.score from bars b left join scores s on b.ticker = s.ticker and b.date = s.date and s.score > 0.5"))
def j2(spark, sf_dir):
    s = t.scores(spark, sf_dir).where("score > 0.5").select("ticker", "date", "score")
    return t.bars(spark, sf_dir).join(s, ["ticker", "date"], "left").select("ticker", "date", "close", "score")


@query("j3_validity_interval", with_views("bars", "shares", sql="""
select b.ticker, b.date, s.shares_outstanding from bars b join (select *, lead(date) over (partition by ticker order by date) as valid_to from shares) s
on b.ticker = s.ticker and b.date >= s.date and (s.valid_to is null or b.date < s.valid_to)"""))
def j3(spark, sf_dir):
    spans = j.validity(t.shares(spark, sf_dir).withColumnRenamed("date", "valid_from"), "ticker", "valid_from")
    return j.interval_join(t.bars(spark, sf_dir), spans, "ticker", "date", "valid_from", "valid_to").select("ticker", "date", "shares_outstanding")


@query("j4_benchmark_by_date", with_views("bars", "bench", sql=f"select ticker, date, {rounded_sql('close / spy_close')} as ratio from bars join bench using (date)"))
def j4(spark, sf_dir):
    return t.bars(spark, sf_dir).join(t.benchmark_series(spark, sf_dir), "date").select("ticker", "date", rounded(F.col("close") / F.col("spy_close")).alias("ratio"))


@query("j5_asof_backward", with_views("bars", "fundamentals", sql="""
select b.ticker, b.date, f.filing_date, f.revenue from bars b asof left join (select ticker, filing_date, max(revenue) as revenue from fundamentals group by 1, 2) f on b.ticker = f.ticker and b.date >= f.filing_date"""))
def j5(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir)
    return j.asof(t.bars(spark, sf_dir).select("ticker", "date"), f, "ticker", "date", "filing_date", ["filing_date", "revenue"])


@query("j7_asof_latest_period", with_views("bars", "fundamentals", sql="""
select b.ticker, b.date, f.period_end, f.net_income from bars b asof left join (select * from fundamentals qualify row_number() over (partition by ticker, filing_date order by period_end desc) = 1) f
on b.ticker = f.ticker and b.date >= f.filing_date"""))
def j7(spark, sf_dir):
    f = j.latest_per_key(t.fundamentals(spark, sf_dir), ["ticker", "filing_date"], [F.desc("period_end")])
    return j.asof(t.bars(spark, sf_dir).select("ticker", "date"), f, "ticker", "date", "filing_date", ["period_end", "net_income"])


@query("j8_asof_forward", with_views("bars", "fundamentals", sql="""
select f.ticker, f.filing_date, b.date as next_date, b.close from fundamentals f asof left join bars b on f.ticker = b.ticker and f.filing_date <= b.date"""))
def j8(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("next_date"), "close")
    return j.asof(t.fundamentals(spark, sf_dir).select("ticker", "filing_date"), b, "ticker", "filing_date", "next_date", ["next_date", "close"], forward=True)


@query("j9_nearest", with_views("bars", "fundamentals", sql="""
select f.ticker, f.period_end, b.date as near_date, b.close from fundamentals f left join bars b on f.ticker = b.ticker and abs(date_diff('day', f.period_end, b.date)) <= 7
qualify row_number() over (partition by f.ticker, f.period_end order by abs(date_diff('day', f.period_end, b.date)), b.date) = 1"""))
def j9(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("near_date"), "close")
    return j.nearest(t.fundamentals(spark, sf_dir).select("ticker", "period_end"), b, "ticker", "period_end", "near_date", ["near_date", "close"], 7)


@query("j10_next_event", with_views("bars", "fundamentals", sql="""
select b.ticker, b.date, min(f.filing_date) as next_date from bars b left join fundamentals f on b.ticker = f.ticker and f.filing_date > b.date and f.filing_date <= b.date + 60 group by 1, 2"""))
def j10(spark, sf_dir):
    return j.next_event(t.bars(spark, sf_dir).select("ticker", "date"), t.fundamentals(spark, sf_dir), "ticker", "date", "filing_date", 60).select("ticker", "date", "next_date")


@query("j11_first_prior_signal", with_views("scores", "fundamentals", sql="""
select f.ticker, f.filing_date, min(s.date) as first_signal from fundamentals f left join scores s on f.ticker = s.ticker and s.date >= f.filing_date - 60 and s.date < f.filing_date and s.score >= 0.8 group by 1, 2"""))
def j11(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir).select("ticker", "filing_date").distinct()
    s = t.scores(spark, sf_dir).where("score >= 0.8").select(F.col("ticker").alias("k"), "date")
    near = (F.col("k") == F.col("ticker")) & (F.col("date") >= F.date_sub("filing_date", 60)) & (F.col("date") < F.col("filing_date"))
    return f.join(s, near, "left").groupBy("ticker", "filing_date").agg(F.min("date").alias("first_signal"))


@query("j15_j16_semi_anti", with_views("bars", "profiles", sql="select 'semi' as kind, count(*) as n from bars where ticker in (select ticker from profiles where is_active) union all select 'anti', count(*) from bars where ticker not in (select ticker from profiles where is_active)"))
def j15(spark, sf_dir):
    b, p = t.bars(spark, sf_dir).select("ticker"), t.profiles(spark, sf_dir).where("is_active").select("ticker")
    one = lambda how, name: b.join(p, "ticker", how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
    return one("left_semi", "semi").unionByName(one("left_anti", "anti"))


@query("j17_prior_pass", with_views("bars", more=FLAGGED, sql=f"select ticker, date, coalesce(max(cast(trend_ok as int)) over (partition by ticker order by date rows between unbounded preceding and 1 preceding), 0) as passed_before from flagged"))
def j17(spark, sf_dir):
    w0 = panel().rowsBetween(Window.unboundedPreceding, -1)
    return flagged(spark, sf_dir).select("ticker", "date", F.coalesce(F.max(F.col("trend_ok").cast("int")).over(w0), F.lit(0)).alias("passed_before"))


@query("j19_outer_fill", with_views("macro", sql="""
select date, last_value(a ignore nulls) over w as a, last_value(b ignore nulls) over w as b from
(select date, max(case when symbol = '1-URGENT' then close end) as a, max(case when symbol = '5-LOW' then close end) as b from macro where symbol in ('1-URGENT', '5-LOW') group by date) window w as (order by date rows between unbounded preceding and current row)"""))
def j19(spark, sf_dir):
    m = t.macro(spark, sf_dir)
    one = lambda s, n: m.where(F.col("symbol") == s).select("date", F.col("close").alias(n))
    return j.outer_fill([one("1-URGENT", "a"), one("5-LOW", "b")], "date")


@query("j20_calendar_fill", with_views("macro", sql="""
select symbol, date, last_value(close ignore nulls) over (partition by symbol order by date rows between unbounded preceding and current row) as close
from (select s.symbol, d.date, m.close from (select symbol, min(date) as lo from macro group by symbol) s join (select distinct date from macro) d on d.date >= s.lo left join macro m on m.symbol = s.symbol and m.date = d.date)"""))
def j20(spark, sf_dir):
    m = t.macro(spark, sf_dir)
    return j.fill_calendar(m, "symbol", "date", ["close"], m.select("date").distinct())


@query("j21_attach_flags", with_views("bars", more=FLAGGED, sql="select b.ticker, b.date, coalesce(f.breakout_ok, false) as breakout_ok from bars b left join (select * from flagged where date >= date '1997-01-01') f on b.ticker = f.ticker and b.date = f.date"))
def j21(spark, sf_dir):
    return j.attach_flags(t.bars(spark, sf_dir).select("ticker", "date"), flagged(spark, sf_dir).where("date >= '1997-01-01'"), ["ticker", "date"], ["breakout_ok"])


@query("j22_align_versions", with_views("bars", more=OLD_NEW, sql="select coalesce(o.ticker, n.ticker) as ticker, coalesce(o.date, n.date) as date, o.close as close_a, n.close as close_b from old o full join new n on o.ticker = n.ticker and o.date = n.date"))
def j22(spark, sf_dir):
    return j.align_versions(*old_new(spark, sf_dir), ["ticker", "date"], ["close"])


@query("j23_next_price", with_views("bars", "fundamentals", sql=f"select f.ticker, f.filing_date, b.next_close from fundamentals f join (select ticker, date, lead(close) {LINE} as next_close from bars) b on f.ticker = b.ticker and f.filing_date = b.date"))
def j23(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("filing_date"), F.lead("close").over(panel()).alias("next_close"))
    return t.fundamentals(spark, sf_dir).select("ticker", "filing_date").join(b, ["ticker", "filing_date"])


@query("a1_a3_grouped", f"""select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty, {rounded_sql('avg(l_discount)')} as disc, round(min(l_extendedprice), 2) as lo, round(max(l_extendedprice), 2) as hi,
count(distinct l_suppkey) as suppliers, count(*) filter (where l_quantity > 25) as big, count(distinct l_partkey) filter (where l_tax > 0.04) as taxed from lineitem group by 1, 2""")
def a1(spark, sf_dir):
    d = t.table(spark, sf_dir, "lineitem")
    return d.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), rounded(F.avg("l_discount")).alias("disc"), F.round(F.min("l_extendedprice"), 2).alias("lo"), F.round(F.max("l_extendedprice"), 2).alias("hi"),
        F.count_distinct("l_suppkey").alias("suppliers"), F.count_if(F.col("l_quantity") > 25).alias("big"), F.count_distinct(F.when(F.col("l_tax") > 0.04, F.col("l_partkey"))).alias("taxed"))


@query("a4_a5_extremes", with_views("bars", sql="select ticker, arg_max(date, (close, date)) as top_date, arg_min(date, (close, date)) as low_date, arg_min(close, date) as first_close, arg_max(close, date) as last_close from bars group by ticker"))
def a4(spark, sf_dir):
    key = F.struct("close", "date")
    return t.bars(spark, sf_dir).groupBy("ticker").agg(F.max_by("date", key).alias("top_date"), F.min_by("date", key).alias("low_date"), F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))


@query("a6_quantiles", with_views("bars", sql="select ticker, " + ", ".join(f"{rounded_sql(f'quantile_cont(close, {q})')} as p{int(q * 100)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " from bars group by ticker"))
def a6(spark, sf_dir):
    return t.bars(spark, sf_dir).groupBy("ticker").agg(*[rounded(F.percentile("close", F.lit(q))).alias(f"p{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)])


@query("a7_histogram", with_views("bars", sql=f"select bin, count(*) as n from (select least(greatest(cast(floor((close / open - 1 + 0.08) / 0.005) as int), 0), 31) as bin from bars) group by bin"))
def a7(spark, sf_dir):
    b = F.least(F.greatest(F.floor((F.col("close") / F.col("open") - 1 + 0.08) / 0.005).cast("int"), F.lit(0)), F.lit(31))
    return t.bars(spark, sf_dir).select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("a8_having", with_views("bars", sql="select ticker, count(*) as n from bars group by ticker having count(*) > 540"))
def a8(spark, sf_dir):
    return t.bars(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).where("n > 540")


@query("a15_two_level", with_views("bars", "profiles", sql=f"select sector, {rounded_sql('avg(n)')} as mean_n from (select sector, date, count(*) as n from bars join profiles using (ticker) group by 1, 2) group by sector"))
def a15(spark, sf_dir):
    d = t.bars(spark, sf_dir).join(t.profiles(spark, sf_dir), "ticker").groupBy("sector", "date").agg(F.count(F.lit(1)).alias("n"))
    return d.groupBy("sector").agg(rounded(F.avg("n")).alias("mean_n"))


@query("a16_monthly_returns", with_views("bars", sql=f"select ticker, month, {rounded_sql('arg_max(close, date) / arg_min(close, date) - 1')} as r from (select *, cast(date_trunc('month', date) as date) as month from bars) group by 1, 2"))
def a16(spark, sf_dir):
    b = t.bars(spark, sf_dir).withColumn("month", F.trunc("date", "month"))
    return b.groupBy("ticker", "month").agg(rounded(F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("r"))


@query("a17_concurrent_active", with_views("fundamentals", sql="""
select day, cast(sum(sum(d)) over (order by day) as bigint) as active from (select filing_date as day, 1 as d from fundamentals union all select filing_date + 45, -1 from fundamentals) group by day"""))
def a17(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir)
    deltas = f.select(F.col("filing_date").alias("day"), F.lit(1).alias("d")).unionByName(f.select(F.date_add("filing_date", 45).alias("day"), F.lit(-1).alias("d")))
    return deltas.groupBy("day").agg(F.sum("d").alias("d")).select("day", F.sum("d").over(Window.orderBy("day")).alias("active"))  # one row a day


@query("a18_positions", with_views("fills", sql="""select ticker, round(sum(case when side = 'BUY' then quantity else -quantity end), 4) as net_qty, round(sum(case when side = 'BUY' then quantity * price end) / sum(case when side = 'BUY' then quantity end), 3) as avg_cost,
round(sum(fees), 4) as fees, min(trade_date) as first_date, max(trade_date) as last_date from fills group by ticker"""))
def a18(spark, sf_dir):
    buy = F.col("side") == "BUY"
    return t.fills(spark, sf_dir).groupBy("ticker").agg(
        F.round(F.sum(F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))), 4).alias("net_qty"), F.round(F.sum(F.when(buy, F.col("quantity") * F.col("price"))) / F.sum(F.when(buy, F.col("quantity"))), 3).alias("avg_cost"),
        F.round(F.sum("fees"), 4).alias("fees"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query("a22_group_lift", with_views("scores", "profiles", sql=f"""select sector, {rounded_sql('top * 1.0 / all_top')} as top_share, {rounded_sql('(top * 1.0 / all_top) / (n * 1.0 / all_n)')} as lift from (
select sector, count(*) as n, count(*) filter (where score >= 0.9) as top, sum(count(*)) over () as all_n, sum(count(*) filter (where score >= 0.9)) over () as all_top from scores join profiles using (ticker) group by sector)"""))
def a22(spark, sf_dir):
    d = t.scores(spark, sf_dir).join(t.profiles(spark, sf_dir), "ticker").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 0.9).alias("top"))
    every = Window.partitionBy(F.lit(1))  # one row a sector
    share = F.col("top") / F.sum("top").over(every)
    return d.select("sector", rounded(share).alias("top_share"), rounded(share / (F.col("n") / F.sum("n").over(every))).alias("lift"))


@query("a26_breadth_two_grains", with_views("bars", "profiles", more=FLAGGED, sql="select sector, industry, count(*) as n, count(*) filter (where trend_ok) as up from flagged join profiles using (ticker) group by grouping sets ((sector), (sector, industry))"))
def a26(spark, sf_dir):
    d = flagged(spark, sf_dir).join(t.profiles(spark, sf_dir), "ticker")
    sets = d.groupingSets([[F.col("sector")], [F.col("sector"), F.col("industry")]], F.col("sector"), F.col("industry"))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if("trend_ok").alias("up"))


@query("a28_group_correlation", with_views("bars", "profiles", sql=f"""select a.sector as s1, b.sector as s2, {rounded_sql('corr(a.r, b.r)')} as c from d a join d b on a.date = b.date and a.sector < b.sector group by 1, 2""", more=f"d as (select date, sector, avg(close / open - 1) as r from bars join profiles using (ticker) group by 1, 2)"))
def a28(spark, sf_dir):
    d = t.bars(spark, sf_dir).join(t.profiles(spark, sf_dir), "ticker").groupBy("date", "sector").agg(F.avg(F.col("close") / F.col("open") - 1).alias("r"))
    a, b = d.select("date", F.col("sector").alias("s1"), F.col("r").alias("ra")), d.select("date", F.col("sector").alias("s2"), F.col("r").alias("rb"))
    return a.join(b, "date").where("s1 < s2").groupBy("s1", "s2").agg(rounded(F.corr("ra", "rb")).alias("c"))


@query("q1_q2_top_k", with_views("scores", sql="select ticker, date, round(score, 6) as score from scores order by score desc nulls last, ticker, date limit 50"))
def q2(spark, sf_dir):
    return t.scores(spark, sf_dir).orderBy(F.desc_nulls_last("score"), "ticker", "date").limit(50).select("ticker", "date", F.round("score", 6).alias("score"))


@query("q3_top_k_per_group", with_views("scores", sql="select date, ticker from scores qualify row_number() over (partition by date order by score desc, ticker) <= 3"))
def q3(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))
    return t.scores(spark, sf_dir).withColumn("r", r).where("r <= 3").select("date", "ticker")


@query("q4_last_dates", with_views("bars", sql="select ticker, date from bars where date in (select distinct date from bars order by date desc limit 5)"))
def q4(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", "date")
    return b.join(b.select("date").distinct().orderBy(F.desc("date")).limit(5), "date", "left_semi").select("ticker", "date")


@query("q5_q7_set_operations", with_views("bars", more=OLD_NEW, sql="select 'union' as kind, count(*) as n from (select ticker, date from old union select ticker, date from new) union all select 'difference', count(*) from (select ticker, date from old except select ticker, date from new)"))
def q5(spark, sf_dir):
    old, new = (x.select("ticker", "date") for x in old_new(spark, sf_dir))
    n = lambda d, k: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(old.union(new).distinct(), "union").unionByName(n(old.join(new, ["ticker", "date"], "left_anti"), "difference"))


@query("q6_w35_latest_per_key", with_views("bars", sql="select ticker, date, close from bars qualify row_number() over (partition by ticker order by date desc) = 1"))
def q6(spark, sf_dir):
    return j.latest_per_key(t.bars(spark, sf_dir).select("ticker", "date", "close"), ["ticker"], [F.desc("date")])


@query("q9_date_series", with_views("bars", sql="select cast(d as date) as date from (select unnest(generate_series(min(date), max(date), interval 1 day)) as d from bars)"))
def q9(spark, sf_dir):
    return t.bars(spark, sf_dir).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
