"""Writes and lookups (K, P, J), signals (W, G), regimes (M), evaluation (T), audits (C) and evidence (X)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import panel
from barsmith.operators import joins as j
from barsmith.operators import quality as q
from barsmith.operators import sessions as se
from barsmith.operators import signals as sg
from barsmith.operators import stats as st
from barsmith.operators import text as tx
from barsmith.operators import trades as tr
from barsmith.operators import writes as wr
from barsmith.plans.base import LINE, over
from barsmith.plans.features import FLAGGED, P3, flagged, now
from barsmith.plans.features import rounded_sql as r
from barsmith.plans.markets import PILLARS, WIDE, day_line, filled, pillars
from barsmith.plans.screening import KIND, rule
from barsmith.plans.serving import T2, T3, latest_bars, screener, session_features
from barsmith.plans.statistics import IC, PANEL_SQL, scored
from barsmith.plans.timeline import ENTRIES, SESSIONS, hold, sessions_of
from barsmith.sources import tables as t

# ---- writes and lookups


@rule("k2_calendar_files", ("fundamentals",), "select distinct ticker, filing_date from fundamentals")
def k2(spark, sf_dir):
    """One folder of files a ticker, read back as one table; the ticker comes from the path."""
    return wr.reread(t.fundamentals(spark, sf_dir).select("ticker", "filing_date"), "calendar", by="ticker").select("ticker", "filing_date").distinct()


@rule("k14_materialised", ("bars",), f"select ticker, date, {r('close')} as close, {r(f'avg(close) {over(20)}')} as sma_20 from bars")
def k14(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date", "close", F.avg("close").over(c.back(20)).alias("sma_20"))
    return wr.reread(d.withColumn("cached_at", F.current_timestamp()), "screen").where("cached_at is not null").drop("cached_at")


@rule("k19_one_quarter", ("bars",), f"select ticker, date, {r('sma_20')} as sma_20 from (select ticker, date, avg(close) {over(20)} as sma_20 from bars) where date between date '1997-04-01' and date '1997-06-30'")
def k19(spark, sf_dir):
    average = lambda d: d.select("ticker", "date", F.avg("close").over(c.back(20)).alias("sma_20"))
    return wr.by_period(t.bars(spark, sf_dir), "date", "1997-04-01", "1997-06-30", 730, average)


P5_LIST = ", ".join(f"case when {s} then null else '{n}' end" for n, _, s in P3)


@rule("p5_entry_diagnosis", ("scores",), f"""select e.ticker, e.entry_date, f.date as judged_on, coalesce(trend_ok, false) as trend_ok, array_to_string(list_filter([{P5_LIST}], lambda x: x is not null), ',') as failed
from entries e asof left join flagged f on f.ticker = e.ticker and e.entry_date >= f.date""", f"{FLAGGED},\n{ENTRIES}")
def p5(spark, sf_dir):
    failed = F.array_join(F.array_compact(F.array(*[F.when(now(x), None).otherwise(F.lit(n)) for n, x, _ in P3])), ",")
    f = flagged(spark, sf_dir).select("ticker", F.col("date").alias("judged_on"), F.coalesce("trend_ok", F.lit(False)).alias("trend_ok"), failed.alias("failed"))
    d = j.asof(tr.select_entries(t.scores(spark, sf_dir), 0.95, 2), f, "ticker", "entry_date", "judged_on", ["judged_on", "trend_ok", "failed"])
    return d.select("ticker", "entry_date", "judged_on", F.coalesce("trend_ok", F.lit(False)).alias("trend_ok"), "failed")


@rule("p7_criteria_version", ("bars",), """select ticker, session_id, entry_date, v.version from sessions asof left join (select d, row_number() over (order by d) as version from (select min(date) as d from bars group by year(date))) v on entry_date >= v.d""", f"{FLAGGED},\n{SESSIONS}")
def p7(spark, sf_dir):
    """The version in force at entry: versions start with a year's first bar; their list, a row a year, goes along as one array."""
    starts = t.bars(spark, sf_dir).groupBy(F.year("date").alias("y")).agg(F.min("date").alias("d"))
    listed = starts.agg(F.sort_array(F.collect_list("d")).alias("starts"))
    version = F.nullif(F.size(F.filter("starts", lambda d: d <= F.col("entry_date"))), F.lit(0))
    return sessions_of(spark, sf_dir).crossJoin(F.broadcast(listed)).select("ticker", "session_id", "entry_date", version.cast("long").alias("version"))


LEAKS = ("mfe", "return_", "_rank")


@rule("p29_forbidden_features", ("bars",), "select column_name as feature from (describe t2) where " + " or ".join(f"contains(column_name, '{w}')" for w in LEAKS), T2)
def p29(spark, sf_dir):
    bad = sg.forbidden_names(screener(spark, sf_dir).columns, LEAKS)
    return spark.createDataFrame([(n,) for n in bad], "feature string")


@rule("j18_frontier", ("bars",), "select ticker, date, (select max(date) from bars) - date as days_behind from (select ticker, max(date) as date from bars group by ticker)")
def j18(spark, sf_dir):
    last = t.bars(spark, sf_dir).groupBy("ticker").agg(F.max("date").alias("date"))
    frontier = last.agg(F.max("date").alias("frontier"))  # one row
    return last.crossJoin(F.broadcast(frontier)).select("ticker", "date", F.date_diff("frontier", "date").alias("days_behind"))


# ---- signals

ROLLING_T = """ics as (select date, ic, list(ic) filter (where ic is not null) over (order by date rows between 251 preceding and current row) as x from ic),
errs as (select *, list_avg(x) as mu, list_transform(x, lambda v: v - list_avg(x)) as e, len(x) as n from ics),
covs as (select *, list_sum(list_transform(e, lambda v: v * v)) / n + """ + " + ".join(f"2 * {1 - k / 6} * coalesce(list_sum(list_transform(range(1, n - {k} + 1), lambda i: e[i] * e[i + {k}])), 0) / n" for k in range(1, 6)) + " as var from errs)"


@rule("w29_rolling_t", ("scores",), f"select date, {r('ic')} as ic, case when n >= 7 and var > 0 then {r('mu / sqrt(var / n)')} end as t_stat from covs", f"{PANEL_SQL},\n{IC},\n{ROLLING_T}")
def w29(spark, sf_dir):
    d = st.daily_ic(scored(spark, sf_dir), "score", "fwd")  # a row a day
    values = F.collect_list("ic").over(day_line().rowsBetween(-251, 0))
    return d.select("date", "ic", values.alias("x")).select("date", "ic", sg.newey_west_t(F.col("x")).alias("t_stat"))


@rule("w40_cohort_percentile", ("scores",), f"""select s.ticker, s.date, {r('(select count(*) filter (where o.score <= s.score) * 1.0 / count(*) from numbered o where o.n between s.n - 9 and s.n)')} as percentile from numbered s""",
      "numbered as (select *, dense_rank() over (order by date) as n from scores)")
def w40(spark, sf_dir):
    return sg.cohort_percentile(t.scores(spark, sf_dir), "score", 10).select("ticker", "date", "percentile")


SWINGS = f"""lines as (select ticker, date, close, ln(close) as x, coalesce(avg(high - low) {over(14)} / close, 0.02) as rev, row_number() over (partition by ticker order by date) as k from bars),
walk as (select ticker, k, 1 as best, x as top, cast(null as bigint) as mark, 0 as kind, 0 as leg from lines where k = 1
  union all select w.ticker, l.k, case when g > 0 or -g >= l.rev then l.k else w.best end, case when g > 0 or -g >= l.rev then l.x else w.top end, case when g <= 0 and -g >= l.rev then w.best end,
    case when g <= 0 and -g >= l.rev then legs else 0 end, case when g <= 0 and -g >= l.rev then -legs else legs end
  from (select w0.*, l0.k as k2, case when w0.leg <> 0 then w0.leg when l0.x >= w0.top then 1 else -1 end as legs, (case when w0.leg <> 0 then w0.leg when l0.x >= w0.top then 1 else -1 end) * (l0.x - w0.top) as g from walk w0 join lines l0 on l0.ticker = w0.ticker and l0.k = w0.k + 1) w
  join lines l on l.ticker = w.ticker and l.k = w.k2),
pivots as (select l.ticker, l.date, l.x, l.k, coalesce(m.kind, 0) as swing from lines l left join (select ticker, mark, kind from walk where mark is not null) m on m.ticker = l.ticker and m.mark = l.k)"""


def swing_input(spark, sf_dir) -> DataFrame:
    """Log closes with a reversal of the mean range of 14 bars over the close."""
    reversal = F.coalesce(F.avg(F.col("high") - F.col("low")).over(c.back(14)) / F.col("close"), F.lit(0.02))
    return t.bars(spark, sf_dir, lines=True).select("ticker", "date", F.log("close").alias("x"), reversal.alias("rev"))


@rule("g11_swing_pivots", ("bars",), "select ticker, date, swing from pivots", SWINGS)
def g11(spark, sf_dir):
    return sg.swings(swing_input(spark, sf_dir), "x", "rev")


@rule("g12_trend_segments", ("bars",), f"""select ticker, date, swing = 1 as pivot_high, swing = -1 as pivot_low, case when k >= 63 then {r('1000 * regr_slope(x, kd) over w')} end as slope_63, case when k >= 63 then {r('regr_r2(x, kd) over w')} end as slope_r2_63, cast(sign(x - lag(x, 252) {LINE}) as int) as prior_slope_sign
from (select *, cast(k as double) as kd from pivots) window w as (partition by ticker order by date rows between 62 preceding and current row)""", SWINGS)
def g12(spark, sf_dir):
    """Pivots, slope (per 1000 bars) and fit of the log price over 63 bars, and the sign of the change over 252."""
    k, w = F.row_number().over(panel()).cast("double"), c.back(63)
    whole = lambda v: F.when(F.col("k") >= 63, v)
    d = swing_input(spark, sf_dir).withColumn("k", k).select(
        "ticker", "date", "x", "rev", whole(1000 * F.regr_slope("x", "k").over(w)).alias("slope_63"), whole(F.regr_r2("x", "k").over(w)).alias("slope_r2_63"),
        F.signum(F.col("x") - F.lag("x", 252).over(panel())).cast("int").alias("prior_slope_sign"))
    d = sg.with_swings(d, "x", "rev", dealt=True)
    return d.select("ticker", "date", (F.col("swing") == 1).alias("pivot_high"), (F.col("swing") == -1).alias("pivot_low"), "slope_63", "slope_r2_63", "prior_slope_sign")


@rule("g4_other_kinds_enrolled", ("bars", "profiles"), f"""select ticker, min(date) as first_date, {r('arg_max(close, date)')} as last_close from bars
where ticker in (select ticker from profiles where coalesce({KIND}, 'EQUITY') <> 'EQUITY') and ticker not in (select ticker from bars where close >= 100000) group by ticker""")
def g4(spark, sf_dir):
    """Tickers of other kinds than equity that no membership log has yet."""
    b = t.bars(spark, sf_dir)
    others = t.profiles(spark, sf_dir).where("sector = 'ASIA'").select("ticker")
    known = se.membership_log(b, F.col("close") >= 100000, 5).select("ticker").distinct()
    d = b.join(others, "ticker", "left_semi").join(known, "ticker", "left_anti")
    return d.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max_by("close", "date").alias("last_close"))


@rule("g7_daily_step", ("bars",), f"""select s.ticker, s.entry_date, case when s.exit_date is not null then s.exit_date when d.ticker is not null and not d.h then d.date end as exit_date from before s left join lastday d using (ticker)
union all select ticker, date, null from lastday where h and coalesce(breakout_ok, false) and ticker not in (select ticker from before where exit_date is null)""", f"""{FLAGGED},
{SESSIONS},
before as (select ticker, entry_date, case when exit_date < e then exit_date end as exit_date from sessions, (select max(date) as e from bars) where entry_date < e),
lastday as (select *, coalesce(close > s5 and close > s15, false) as h from flagged where date = (select max(date) from bars))""")
def g7(spark, sf_dir):
    """The sessions known before the table's last day, taken one day on."""
    end = t.table(spark, sf_dir, "lineitem", "l_shipdate").agg(F.max(F.to_date("l_shipdate")).alias("end"))  # one row
    sessions, day = se.sessions_and_day(flagged(spark, sf_dir), hold(), F.col("breakout_ok"), end)
    state = sessions.crossJoin(F.broadcast(end)).where("entry_date < end")
    state = state.select("ticker", "entry_date", F.when(F.col("exit_date") < F.col("end"), F.col("exit_date")).alias("exit_date"))
    return se.step_sessions(state, day)


# ---- regimes

@rule("m9_feature_checks", ("macro",), " union all ".join(f"select '{n}' as feature, count(*) filter (where {n} is null) as nulls, {r(f'min({n})')} as lowest, {r(f'max({n})')} as highest, coalesce(bool_and({n} between 0 and 100), false) as in_range from pillars" for n in ("trend", "risk")), f"{WIDE},\n{PILLARS}")
def m9(spark, sf_dir):
    return q.feature_checks(pillars(spark, sf_dir), {"trend": (0.0, 100.0), "risk": (0.0, 100.0)})


GOVERNOR = """stress as (select date, a as s, quantile_cont(a, 0.8) over (order by date rows between unbounded preceding and 1 preceding) as cut, count(a) over (order by date rows between unbounded preceding and 1 preceding) as n from filled),
gate as (select date, spy_close > avg(spy_close) over (order by date rows between 199 preceding and current row) as open from bench),
sized as (select g.date, case when not open then 0.0 when coalesce(n, 0) < 60 or s >= cut then 1.0 else 0.5 end as w from gate g asof left join stress s on g.date >= s.date)"""


@rule("m15_governor_weight", ("macro", "bars", "bench"), f"select date, {r('coalesce(lag(w) over (order by date), 1.0)')} as exposure from sized", f"{WIDE},\n{GOVERNOR}")
def m15(spark, sf_dir):
    """Full size where stress is in its own top fifth so far, half below, none under the benchmark's average; one day late."""
    so_far = day_line().rowsBetween(Window.unboundedPreceding, -1)  # series of a row a day
    stress = filled(spark, sf_dir).select("date", "a", F.percentile("a", F.lit(0.8)).over(so_far).alias("cut"), F.count("a").over(so_far).alias("n"))
    gate = t.benchmark_series(spark, sf_dir).select("date", (F.col("spy_close") > F.avg("spy_close").over(day_line().rowsBetween(-199, 0))).alias("open"))
    d = j.asof(gate.withColumn("k", F.lit(0)), stress.withColumn("k", F.lit(0)), "k", "date", "date", ["a", "cut", "n"])
    w = F.when(~F.col("open"), 0.0).when((F.coalesce("n", F.lit(0)) < 60) | (F.col("a") >= F.col("cut")), 1.0).otherwise(0.5)
    return d.select("date", w.alias("w")).select("date", F.coalesce(F.lag("w").over(day_line()), F.lit(1.0)).alias("exposure"))


@rule("m18_weather", ("bars", "macro"), f"""select date, {r('trend')} as trend, coalesce(n, 0) as breakouts, case when trend < 40 then 'storm' when coalesce(n, 0) = 0 then 'drought' when trend >= 60 then 'fair' else 'mixed' end as gauge
from pillars left join (select date, count(*) filter (where breakout_ok) as n from flagged group by date) using (date)""", f"{WIDE},\n{PILLARS},\n{FLAGGED}")
def m18(spark, sf_dir):
    supply = flagged(spark, sf_dir).groupBy("date").agg(F.count_if("breakout_ok").alias("n"))
    n = F.coalesce("n", F.lit(0))
    gauge = F.when(F.col("trend") < 40, "storm").when(n == 0, "drought").when(F.col("trend") >= 60, "fair").otherwise("mixed")
    return pillars(spark, sf_dir).join(supply, "date", "left").select("date", "trend", n.alias("breakouts"), gauge.alias("gauge"))


CAPE = """yearly as (select ticker, period_end, total_equity as cap, count(net_income) over w as have, sum(net_income) over w as ttm from fundamentals window w as (partition by ticker order by period_end rows between 3 preceding and current row)),
smooth as (select *, avg(case when have = 4 then ttm end) over (partition by ticker order by period_end rows between 11 preceding and current row) as mean_ttm from yearly),
basket as (select *, cap / mean_ttm as cape from smooth where mean_ttm > 0 qualify row_number() over (partition by period_end order by cap desc, ticker) <= 50),
ends as (select period_end, quantile_cont(cape, 0.05) as lo, quantile_cont(cape, 0.95) as hi from basket group by 1)"""


@rule("m19_smoothed_valuation", ("fundamentals",), f"select period_end, count(*) as members, {r('sum(least(greatest(cape, lo), hi) * cap) / sum(cap)')} as cape from basket join ends using (period_end) group by period_end", CAPE)
def m19(spark, sf_dir):
    """Size over the mean of 12 trailing-year incomes, the 50 largest of a quarter, winsorised and weighted by size."""
    w = Window.partitionBy("ticker").orderBy("period_end")
    year = w.rowsBetween(-3, 0)
    d = t.fundamentals(spark, sf_dir).select("ticker", "period_end", F.col("total_equity").alias("cap"), F.when(F.count("net_income").over(year) == 4, F.sum("net_income").over(year)).alias("ttm"))
    d = d.withColumn("mean_ttm", F.avg("ttm").over(w.rowsBetween(-11, 0))).where("mean_ttm > 0").withColumn("cape", F.col("cap") / F.col("mean_ttm"))
    place = F.row_number().over(Window.partitionBy("period_end").orderBy(F.desc("cap"), "ticker"))
    d = d.withColumn("place", place).where("place <= 50")
    ends = d.groupBy("period_end").agg(F.percentile("cape", F.array(F.lit(0.05), F.lit(0.95))).alias("e"))
    inside = F.least(F.greatest("cape", F.col("e")[0]), F.col("e")[1])
    return d.join(ends, "period_end").groupBy("period_end").agg(F.count(F.lit(1)).alias("members"), (F.sum(inside * F.col("cap")) / F.sum("cap")).alias("cape"))


BEAR = "regime as (select date, trend, bear from (select date, cast(spy_close < avg(spy_close) over (order by date rows between 199 preceding and current row) as int) as bear from bench) join pillars using (date) where trend is not null)"


@rule("m20_regime_quality", ("macro", "bars", "bench"), f"""select {r('count(*) filter (where bear = 1 and trend < 50) * 1.0 / sum(bear)')} as capture, {r('count(*) filter (where bear = 0 and trend < 50) * 1.0 / sum(1 - bear)')} as false_alarm,
{r('(avg(trend) filter (where bear = 0) - avg(trend) filter (where bear = 1)) / sqrt((var_samp(trend) filter (where bear = 0) + var_samp(trend) filter (where bear = 1)) / 2)')} as cohens_d,
(select {r('sum((select count(*) from regime o where o.bear = 0 and o.trend < g.trend) + 0.5 * (select count(*) from regime o where o.bear = 0 and o.trend = g.trend)) / (sum(1.0) * (select count(*) from regime where bear = 0))')} from regime g where bear = 1) as auc from regime""", f"{WIDE},\n{PILLARS},\n{BEAR}")
def m20(spark, sf_dir):
    bear = F.col("spy_close") < F.avg("spy_close").over(day_line().rowsBetween(-199, 0))
    b = t.benchmark_series(spark, sf_dir).select("date", bear.cast("int").alias("bear"))
    d = b.join(pillars(spark, sf_dir), "date").where("trend is not null")
    of = lambda f, v: f(F.when(F.col("bear") == v, F.col("trend")))
    low = lambda v: F.count_if((F.col("bear") == v) & (F.col("trend") < 50))
    effect = (of(F.avg, 0) - of(F.avg, 1)) / F.sqrt((of(F.var_samp, 0) + of(F.var_samp, 1)) / 2)
    one = d.agg((low(1) / F.sum("bear")).alias("capture"), (low(0) / F.sum(1 - F.col("bear"))).alias("false_alarm"), effect.alias("cohens_d"))
    return one.crossJoin(F.broadcast(st.roc_auc(d, "trend", "bear")))  # one row each


@rule("m21_calibrated_thresholds", ("macro",), " union all ".join(f"select {p} as pct, {r(f'quantile_cont(trend, {p / 100})')} as threshold from pillars" for p in (20, 40, 60, 80)), f"{WIDE},\n{PILLARS}")
def m21(spark, sf_dir):
    cuts = F.percentile("trend", F.array(*[F.lit(p / 100) for p in (20, 40, 60, 80)]))
    return pillars(spark, sf_dir).agg(cuts.alias("c")).select(F.posexplode("c").alias("i", "threshold")).select(((F.col("i") + 1) * 20).alias("pct"), "threshold")


@rule("e2_share_history", ("bars", "shares"), "select ticker, y as fiscal_year, arg_max(shares_outstanding, date) as shares_outstanding, count(*) as filings from (select *, year(date) as y from shares) group by 1, 2")
def e2(spark, sf_dir):
    return t.shares(spark, sf_dir).groupBy("ticker", F.year("date").alias("fiscal_year")).agg(F.max_by("shares_outstanding", "date").alias("shares_outstanding"), F.count(F.lit(1)).alias("filings"))


# ---- evaluation

CELLS = "cells as (select cast(floor(score * 10) as int) as bin, up, count(*) * 1.0 as n from p group by 1, 2)"


@rule("t6_mutual_information", ("scores",), f"select {r('1000 * sum(n / total * ln(n * total / (bin_n * up_n)))')} as millinats from (select *, sum(n) over () as total, sum(n) over (partition by bin) as bin_n, sum(n) over (partition by up) as up_n from cells)", f"{PANEL_SQL},\n{CELLS}")
def t6(spark, sf_dir):
    cells = scored(spark, sf_dir).groupBy(F.floor(F.col("score") * 10).alias("bin"), "up").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy(*k or [F.lit(0)]))  # noqa: E731  of at most 22 cells
    d = cells.select("n", by().alias("total"), by("bin").alias("bin_n"), by("up").alias("up_n"))
    return d.agg((1000 * F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("bin_n") * F.col("up_n"))))).alias("millinats"))


ISOTONIC = """steps as (select cast(floor(score * 50) as int) as bin, count(*) * 1.0 as n, sum(up) * 1.0 as y from p group by 1),
sums as (select bin, sum(n) over (order by bin) as cn, sum(y) over (order by bin) as cy, sum(n) over (order by bin) - n as bn, sum(y) over (order by bin) - y as by_ from steps)"""


@rule("t19_isotonic_calibration", ("scores",), f"""select bin, {r('max(worst)')} as calibrated from (select i.bin, a.bin as a, min((b.cy - a.by_) / (b.cn - a.bn)) as worst from sums i join sums a on a.bin <= i.bin join sums b on b.bin >= i.bin group by 1, 2) group by bin""", f"{PANEL_SQL},\n{ISOTONIC}")
def t19(spark, sf_dir):
    """The isotonic fit of outcomes on scores, over 50 weighted bins of the score, at every bin."""
    bins = scored(spark, sf_dir).groupBy(F.floor(F.col("score") * 50).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.avg("up").alias("label"))
    points = VectorAssembler(inputCols=["bin"], outputCol="features").transform(bins)
    return IsotonicRegression(weightCol="weight").fit(points).transform(points).select("bin", F.col("prediction").alias("calibrated"))


@rule("t39_lead_time", ("bars", "scores"), f"select count(*) as trades, count(lead_days) as signalled, {r('avg(lead_days)')} as mean_lead, {r('median(lead_days)')} as median_lead from (select s.ticker, s.session_id, date_diff('day', min(c.date), s.entry_date) as lead_days from sessions s left join scores c on c.ticker = s.ticker and c.score >= 0.8 and c.date >= s.entry_date - 60 and c.date < s.entry_date group by 1, 2, s.entry_date)", f"{FLAGGED},\n{SESSIONS}")
def t39(spark, sf_dir):
    s = sessions_of(spark, sf_dir)
    signals = t.scores(spark, sf_dir).where("score >= 0.8").select("ticker", "date")
    spans = s.select("ticker", "session_id", "entry_date", F.date_sub("entry_date", 60).alias("since"))
    first = j.interval_join(signals, spans, "ticker", "date", "since", "entry_date").groupBy("ticker", "session_id").agg(F.min("date").alias("first"))
    d = s.join(first, ["ticker", "session_id"], "left").withColumn("lead", F.date_diff("entry_date", "first"))
    return d.agg(F.count(F.lit(1)).alias("trades"), F.count("lead").alias("signalled"), F.avg("lead").alias("mean_lead"), F.percentile("lead", F.lit(0.5)).alias("median_lead"))


MODEL, INTERCEPT = {"MOM_63D": 0.4, "Mom_Rank": 1.2, "PRICE_VS_SMA_50": -0.3}, -0.5


@rule("t42_batch_scores", ("bars",), f"select ticker, date, {r('1 / (1 + exp(-(-0.5 + 0.4 * mom_63d + 1.2 * mom_rank - 0.3 * price_vs_sma_50)))')} as p from t2", T2)
def t42(spark, sf_dir):
    d = screener(spark, sf_dir)
    return d.select("ticker", "date", sg.linear_score(d, MODEL, INTERCEPT).alias("p"))


@rule("t44_ablation", ("scores", "profiles"), f"select g.sector, {r('avg(up) filter (where x.sector <> g.sector) - avg(up)')} as delta, row_number() over (order by round(avg(up) filter (where x.sector <> g.sector) - avg(up), 9) desc, g.sector) as place from (select distinct sector from profiles) g, (select up, sector from p join profiles using (ticker) where score >= 0.8) x group by g.sector", PANEL_SQL)
def t44(spark, sf_dir):
    """How the hit rate of high scores changes when a sector is left out; from sums by sector alone."""
    d = scored(spark, sf_dir).where("score >= 0.8").join(t.profiles(spark, sf_dir), "ticker").groupBy("sector").agg(F.sum("up").alias("u"), F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))  # a row a sector
    d = t.profiles(spark, sf_dir).select("sector").distinct().join(d, "sector", "left").fillna(0, ["u", "n"])
    all_u, all_n = F.sum("u").over(every), F.sum("n").over(every)
    d = d.select("sector", ((all_u - F.col("u")) / (all_n - F.col("n")) - all_u / all_n).alias("delta"))
    return d.withColumn("place", F.row_number().over(every.orderBy(F.desc(F.round("delta", 9)), "sector")))


# ---- audits

@rule("c14_screener_audit", ("bars",), f"""select date, n, {r('yield')} as trend_yield, coalesce(n < 0.5 * lag(n) over (order by date), false) as dropped, late_nulls, bad_ranks, yield = 0 as no_flags
from (select date, count(*) as n, avg(cast(trend_ok as int)) as yield, count(*) filter (where k > 63 and mom_63d is null) as late_nulls, count(*) filter (where mom_rank not between 0 and 1) as bad_ranks from (select *, row_number() over (partition by ticker order by date) as k from t2) group by date)""", T2)
def c14(spark, sf_dir):
    d = screener(spark, sf_dir).withColumn("k", F.row_number().over(panel()))
    g = d.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("trend_ok").cast("int")).alias("trend_yield"), F.count_if((F.col("k") > 63) & F.col("mom_63d").isNull()).alias("late_nulls"), F.count_if(~F.col("mom_rank").between(0, 1)).alias("bad_ranks"))
    dropped = F.coalesce(F.col("n") < 0.5 * F.lag("n").over(day_line()), F.lit(False))  # a row a day
    return g.select("date", "n", "trend_yield", dropped.alias("dropped"), "late_nulls", "bad_ranks", (F.col("trend_yield") == 0).alias("no_flags"))


@rule("c16_session_audit", ("bars",), f"""select session_year, count(*) as n, count(distinct ticker) as tickers, count(*) filter (where day_in_session > 1 and close_delta is null) as null_changes, count(*) filter (where abs(close_delta) > 5) as wild_changes, count(*) filter (where ticker not in (select ticker from profiles)) as orphans
from (select *, year(date) as session_year from t3) group by session_year""", f"{t.PROFILES},\n{T3}")
def c16(spark, sf_dir):
    known = t.profiles(spark, sf_dir).select("ticker", F.lit(True).alias("known"))
    d = session_features(spark, sf_dir).join(known, "ticker", "left")
    late = (F.col("day_in_session") > 1) & F.col("close_delta").isNull()
    return d.groupBy(F.year("date").alias("session_year")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.count_if(late).alias("null_changes"), F.count_if(F.abs("close_delta") > 5).alias("wild_changes"), F.count_if(F.col("known").isNull()).alias("orphans"))


@rule("c24_cleaned_bars", ("bars",), f"""select ticker, date, case when b.close > 4 * m then 'scale' when coalesce(b.high > 3 * prev and b.high > 3 * next, false) then 'spike' when b.low > least(b.open, b.close) or b.high < greatest(b.open, b.close) then 'ohlc' end as fault,
{r('case when b.close <= 4 * m then b.close end')} as close from (select *, lag(high) {LINE} as prev, lead(high) {LINE} as next from bars) b join (select ticker, median(close) as m from bars group by ticker) using (ticker)""")
def c24(spark, sf_dir):
    """Closes far above the ticker's median become null; high spikes of one bar and broken bars are named."""
    high, w = F.col("high"), panel()
    spike = F.coalesce((high > 3 * F.lag("high").over(w)) & (high > 3 * F.lead("high").over(w)), F.lit(False))
    b = t.bars(spark, sf_dir)
    d = b.withColumn("spike", spike).join(b.groupBy("ticker").agg(F.percentile("close", F.lit(0.5)).alias("m")), "ticker")
    scale = F.col("close") > 4 * F.col("m")
    broken = (F.col("low") > F.least("open", "close")) | (high < F.greatest("open", "close"))
    fault = F.when(scale, "scale").when(F.col("spike"), "spike").when(broken, "ohlc")
    return d.select("ticker", "date", fault.alias("fault"), F.when(~scale, F.col("close")).alias("close"))


REPORT = "select ticker, case when n > 10 * per then 'FAIL' else 'PASS' end as status from (select ticker, count(*) filter (where volume < 10) as n, count(*) / 60.0 as per from bars where {where} group by ticker)"


@rule("c18_audit_diff", ("bars",), f"select b.ticker from ({REPORT.format(where='true')}) b left join ({REPORT.format(where=chr(100) + 'ate < date ' + chr(39) + '1998-01-01' + chr(39))}) a on a.ticker = b.ticker and a.status = 'FAIL' where b.status = 'FAIL' and a.ticker is null")
def c18(spark, sf_dir):
    def report(d):
        g = d.groupBy("ticker").agg(F.count_if(F.col("volume") < 10).alias("n"), (F.count(F.lit(1)) / 60.0).alias("per"))
        return g.select(F.col("ticker").alias("check_name"), F.when(F.col("n") > 10 * F.col("per"), "FAIL").otherwise("PASS").alias("status"))

    b = t.bars(spark, sf_dir)
    return q.report_diff(report(b.where("date < '1998-01-01'")), report(b)).select(F.col("check_name").alias("ticker"))


@rule("c17_serving_checks", ("fills", "bars", "scores"), f"""select ticker, {r('cash + net * last')} as value, coalesce(date_diff('day', traded, d) > 30, true) as stale, coalesce(s is null, true) as unscored
from (select ticker, sum(case when side = 'BUY' then -quantity * price else quantity * price end) as cash, sum(case when side = 'BUY' then quantity else -quantity end) as net, max(trade_date) as traded from fills group by ticker)
left join (select ticker, max(date) as d, arg_max(close, date) as last from bars group by ticker) using (ticker) left join (select ticker, max(score) as s from scores group by ticker) using (ticker)""")
def c17(spark, sf_dir):
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1) * F.col("quantity")
    f = t.fills(spark, sf_dir).groupBy("ticker").agg(F.sum(-sign * F.col("price")).alias("cash"), F.sum(sign).alias("net"), F.max("trade_date").alias("traded"))
    s = t.scores(spark, sf_dir).groupBy("ticker").agg(F.max("score").alias("s"))
    d = f.join(latest_bars(spark, sf_dir), "ticker", "left").join(s, "ticker", "left")
    stale = F.coalesce(F.date_diff("date", "traded") > 30, F.lit(True))
    return d.select("ticker", (F.col("cash") + F.col("net") * F.col("close")).alias("value"), stale.alias("stale"), F.col("s").isNull().alias("unscored"))


@rule("q8_seeded_sample", (), "select o_orderkey from orders order by md5('7|' || cast(o_orderkey as varchar)), o_orderkey limit 100", "no as (select 1)")
def q8(spark, sf_dir):
    """A sample of 100 rows: the same for the same seed, whatever the partitions."""
    d = t.table(spark, sf_dir, "orders", "o_orderkey")
    return d.orderBy(F.md5(F.concat(F.lit("7|"), F.col("o_orderkey").cast("string")).cast("binary")), "o_orderkey").limit(100)


# ---- evidence

def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, payload: a conversation as a nested JSON document whose claims carry evidence."""
    d = t.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").where("text is not null")
    evidence = F.struct(F.substring("text", 1, 24).alias("quote"), F.concat(F.lit("turn-"), F.col("turn").cast("string")).alias("source"), F.when(F.length("text") > 200, "strong").otherwise("weak").alias("strength"))
    claim = F.struct("turn", F.col("role").alias("party"), evidence.alias("evidence"))
    g = d.groupBy(F.col("conv_id").alias("run_id")).agg(F.sort_array(F.collect_list(F.struct("turn", claim.alias("claim")))).alias("c"))
    body = F.struct(F.struct(F.transform("c", lambda x: x["claim"]).alias("claims")).alias("report"))
    return g.select("run_id", F.to_json(body).alias("payload"))


CLAIMS = "claims as (select conv_id as run_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations where text is not null)"


@rule("x1_evidence", (), "select run_id, 'report.claims[' || i || '].evidence' as path, left(text, 24) as quote, 'turn-' || turn as source, case when length(text) > 200 then 'strong' else 'weak' end as strength from claims", CLAIMS)
def x1(spark, sf_dir):
    return tx.evidence(payloads(spark, sf_dir), "run_id", "payload")


def claims(spark, sf_dir) -> DataFrame:
    schema = "report struct<claims: array<struct<turn: bigint, party: string, evidence: struct<quote: string, source: string, strength: string>>>>"
    d = payloads(spark, sf_dir).select("run_id", F.explode(F.from_json("payload", schema)["report"]["claims"]).alias("c"))
    return d.select("run_id", "c.turn", "c.party", "c.evidence.*")


@rule("x6_new_claims", (), "select run_id, turn, role as party, left(text, 24) as quote from claims where run_id not in (select doc_id from labels)", CLAIMS)
def x6(spark, sf_dir):
    done = t.table(spark, sf_dir, "labels", "doc_id").withColumnRenamed("doc_id", "run_id")
    return claims(spark, sf_dir).join(done, "run_id", "left_anti").select("run_id", "turn", "party", "quote")


def verified(spark, sf_dir) -> DataFrame:
    """Claims with verified: is the quote found in the answer's own text? Repeated turns give texts, not rows."""
    source = t.table(spark, sf_dir, "conversations", "conv_id", "turn", "text").where("turn % 2 = 0")
    texts = source.groupBy(F.col("conv_id").alias("run_id"), "turn").agg(F.collect_set("text").alias("texts"))
    d = claims(spark, sf_dir).join(texts, ["run_id", "turn"], "left")
    found = F.exists("texts", lambda x: tx.grounded(tx.normalise("quote"), tx.normalise(x)))
    return d.withColumn("verified", F.coalesce(found, F.lit(False))).drop("texts")


@rule("x4_fidelity", (), f"select run_id, count(*) as claims, count(*) filter (where turn % 2 = 0) as verified, {r('count(*) filter (where turn % 2 = 0) * 1.0 / count(*)')} as fidelity from claims group by run_id", CLAIMS)
def x4(spark, sf_dir):
    g = verified(spark, sf_dir).groupBy("run_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if("verified").alias("verified"))
    return g.select("*", (F.col("verified") / F.col("claims")).alias("fidelity"))


EDGES = f"""{CLAIMS},
made as (select role as party, case when length(text) > 200 then 'strong' else 'weak' end as strength, run_id, turn % 2 = 0 as ok, case when length(text) > 200 then 1.0 else 0.5 end as w from claims),
edges as (select party, strength, count(distinct run_id) as runs_seen, count(distinct run_id) filter (where ok) as runs_verified, avg(w) as weight, min(run_id) as first_run, max(run_id) as last_run from made group by 1, 2),
graph as (select *, weight * runs_verified / runs_seen * runs_seen / total as confidence from edges join (select party, count(distinct run_id) as total from made group by 1) using (party))"""


def edges(spark, sf_dir) -> DataFrame:
    """Edges of party and strength; confidence multiplies weight, verified share and share of the party's runs."""
    d = verified(spark, sf_dir).select("party", "strength", "run_id", "verified", F.when(F.col("strength") == "strong", 1.0).otherwise(0.5).alias("w"))
    runs = d.groupBy("party", "strength", "run_id").agg(F.max("verified").alias("ok"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))  # no distinct over a hot edge in one task
    e = runs.groupBy("party", "strength").agg(F.count(F.lit(1)).alias("runs_seen"), F.count_if("ok").alias("runs_verified"), (F.sum("w") / F.sum("n")).alias("weight"), F.min("run_id").alias("first_run"), F.max("run_id").alias("last_run"))
    totals = runs.select("party", "run_id").distinct().groupBy("party").agg(F.count(F.lit(1)).alias("total"))
    share = F.col("weight") * F.col("runs_verified") / F.col("runs_seen") * F.col("runs_seen") / F.col("total")
    return e.join(totals, "party").withColumn("confidence", share)


@rule("a20_edge_projection", (), f"select party, strength, runs_seen, runs_verified, {r('weight')} as weight, first_run, last_run, {r('confidence')} as confidence from graph", EDGES)
def a20(spark, sf_dir):
    return edges(spark, sf_dir).drop("total")


@rule("x7_edge_graph", (), f"select party as node, count(*) as degree, {r('sum(confidence)')} as strength from graph where confidence > 0 group by party union all select strength, count(*), {r('sum(confidence)')} from graph where confidence > 0 group by strength", EDGES)
def x7(spark, sf_dir):
    e = edges(spark, sf_dir).where("confidence > 0")
    ends = e.select(F.explode(F.array("party", "strength")).alias("node"), "confidence")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("confidence").alias("strength"))


MONTH = "over (partition by ticker order by date range between interval 1 day following and interval 30 days following)"


def month_peak(bars: DataFrame) -> DataFrame:
    """ticker, date, mfe: the highest high of the next 30 calendar days over the close, less 1 (one frame a ticker, no join)."""
    day = F.date_diff("date", F.lit("1970-01-01").cast("date"))
    ahead = Window.partitionBy("ticker").orderBy(day).rangeBetween(1, 30)
    return bars.select("ticker", "date", (F.max("high").over(ahead) / F.col("close") - 1).alias("mfe"))


@rule("l8_stored_labels", ("bars",), f"""select status, count(*) as n from (select case when a.ticker is null then 'missing' when n.date + 30 > e then 'overrun' when abs(a.mfe - n.mfe) > 1e-9 or (a.mfe is null) <> (n.mfe is null) then 'mismatched' else 'ok' end as status
from (select ticker, date, max(high) {MONTH} / close - 1 as mfe from bars) n left join (select ticker, date, max(high) {MONTH} / close - 1 as mfe from bars where date <= date '1998-06-30') a using (ticker, date), (select max(date) as e from bars)) group by status""")
def l8_stored(spark, sf_dir):
    """Labels stored in the middle of 1998 against labels from all bars: missing, mismatched, or with a horizon beyond the table."""
    b = t.bars(spark, sf_dir)
    stored = month_peak(b.where("date <= '1998-06-30'")).select("ticker", "date", F.col("mfe").alias("was"), F.lit(True).alias("have"))
    d = month_peak(b).join(stored, ["ticker", "date"], "left").crossJoin(F.broadcast(b.agg(F.max("date").alias("end"))))  # one row
    differs = (F.abs(F.col("was") - F.col("mfe")) > 1e-9) | (F.col("was").isNull() != F.col("mfe").isNull())
    status = F.when(F.col("have").isNull(), "missing").when(F.date_add("date", 30) > F.col("end"), "overrun").when(differs, "mismatched").otherwise("ok")
    return d.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@rule("c26_job_health", (), f"""select user_id as job, count(*) as runs, {r("avg(cast(event_type <> 'error' as int))")} as success_rate, count(*) filter (where event_type = 'error' and d > e - 7) as failures_7d, date_diff('day', max(d) filter (where event_type <> 'error'), e) as drought_days, date_diff('day', max(d), e) as days_old
from (select *, cast(ts as date) as d from events), (select max(cast(ts as date)) as e from events) group by user_id, e""", "no as (select 1)")
def c26_jobs(spark, sf_dir):
    """Runs of a job (a user of the event log; errors are failures): success rate, last week's failures, days since a success, and since a run."""
    d = t.table(spark, sf_dir, "events", "user_id", "event_type", "ts").select(F.col("user_id").alias("job"), (F.col("event_type") != "error").alias("ok"), F.to_date("ts").alias("d"))
    d = d.crossJoin(F.broadcast(d.agg(F.max("d").alias("e"))))  # one row
    g = d.groupBy("job").agg(
        F.count(F.lit(1)).alias("runs"), F.avg(F.col("ok").cast("int")).alias("success_rate"), F.count_if(~F.col("ok") & (F.col("d") > F.date_sub("e", 7))).alias("failures_7d"),
        F.max(F.when(F.col("ok"), F.col("d"))).alias("good"), F.max("d").alias("last"), F.max("e").alias("e"))
    return g.select("job", "runs", "success_rate", "failures_7d", F.date_diff("e", "good").alias("drought_days"), F.date_diff("e", "last").alias("days_old"))
