"""Screening rules (P), interval joins (J), trade and group aggregates (A), series (W, M), fundamentals (E), writes (K) and checks (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import panel
from barsmith.operators import joins as j
from barsmith.operators import series as se
from barsmith.operators import text as tx
from barsmith.operators import writes as wr
from barsmith.operators.series import exact_quantiles
from barsmith.plans.base import LINE, SO_FAR, over, query, with_views
from barsmith.plans.features import FLAGGED, flagged, rounded
from barsmith.plans.features import rounded_sql as r
from barsmith.plans.markets import WIDE, day_line, filled
from barsmith.plans.timeline import SESSIONS, sessions_of
from barsmith.sources import tables as t


def rule(name: str, views: tuple[str, ...], sql: str, more: str = ""):
    """A query whose doubles are rounded; the SQL rounds its own by r()."""

    def register(fn):
        @query(name, with_views(*views, more=more, sql=sql))
        def run(spark, sf_dir):
            d = fn(spark, sf_dir)
            return d.select(*[rounded(F.col(n)).alias(n) if k == "double" else F.col(n) for n, k in d.dtypes])

        return run

    return register


# ---- predicates and labels

KIND = "case sector when 'ASIA' then 'ETF' when 'AFRICA' then null else 'EQUITY' end"


@rule("p8_equity_only", ("profiles",), f"select ticker from profiles where coalesce({KIND}, 'EQUITY') = 'EQUITY'")
def p8(spark, sf_dir):
    kind = F.when(F.col("sector") == "ASIA", "ETF").when(F.col("sector") != "AFRICA", "EQUITY")
    return t.profiles(spark, sf_dir).where(F.coalesce(kind, F.lit("EQUITY")) == "EQUITY").select("ticker")


@rule("p9_universe_union", ("bars", "profiles"), f"""select distinct ticker from (select ticker from sessions union all select ticker from profiles where is_active union all select ticker from flagged where breakout_ok)
where ticker in (select ticker from bars)""", f"{FLAGGED},\n{SESSIONS}")
def p9(spark, sf_dir):
    some = sessions_of(spark, sf_dir).select("ticker").union(t.profiles(spark, sf_dir).where("is_active").select("ticker")).union(flagged(spark, sf_dir).where("breakout_ok").select("ticker"))
    return some.distinct().join(t.bars(spark, sf_dir), "ticker", "left_semi")


@rule("p13_percent_to_delta", ("bars",), f"select ticker, date, {r('close_pct_chg / 100')} as close_delta, {r('volume_pct_chg / 100')} as volume_delta from pc",
      f"pc as (select ticker, date, (close / nullif(lag(close) {LINE}, 0) - 1) * 100 as close_pct_chg, (volume / nullif(lag(volume) {LINE}, 0) - 1) * 100 as volume_pct_chg from bars)")
def p13(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date", (100 * c.change("close")).alias("close_pct_chg"), (100 * c.change(F.col("volume").cast("double"))).alias("volume_pct_chg"))
    names = [n for n in d.columns if n.endswith("_pct_chg")]
    return d.select(*[n for n in d.columns if n not in names], *[(F.col(n) / 100).alias(n.replace("_pct_chg", "_delta")) for n in names])


@rule("p17_gate_decision", ("scores",), "select ticker, date, score * 100 >= 30 as allow, score * 100 < 50 as reduced from scores")
def p17(spark, sf_dir):
    s = 100 * F.col("score")
    return t.scores(spark, sf_dir).select("ticker", "date", (s >= 30).alias("allow"), (s < 50).alias("reduced"))


@rule("p18_posture", ("macro",), """select date, case when not gate then 'defensive' when x > 150000 then 'cautious' when b > 150000 then 'selective' else 'aggressive' end as posture
from (select *, a > avg(a) over (order by date rows between 49 preceding and current row) as gate from filled) where gate is not null""", WIDE)
def p18(spark, sf_dir):
    d = filled(spark, sf_dir).withColumn("gate", F.col("a") > F.avg("a").over(day_line().rowsBetween(-49, 0))).where("gate is not null")
    return d.select("date", se.ladder([(~F.col("gate"), "defensive"), (F.col("x") > 150000, "cautious"), (F.col("b") > 150000, "selective")], "aggressive").alias("posture"))


STAGE = f"""st as (select ticker, date, sign(ln(close) - ln(lag(close, 60) {LINE})) as prior, regr_slope(ln(close), k) {over(20)} as slope, close > avg(close) {over(20)} as template
from (select *, cast(row_number() {LINE} as double) as k from bars))"""


@rule("p19_w21_market_stage", ("bars",), """select ticker, date, cast(prior as int) as prior_slope_sign, case when template and slope > 0 then 2 when slope < 0 and not template then 4 when prior > 0 then 3 else 1 end as stage from st where prior is not null and slope is not null""", STAGE)
def p19(spark, sf_dir):
    d = t.bars(spark, sf_dir).withColumn("k", F.row_number().over(panel()).cast("double"))
    d = d.withColumns({"prior": F.signum(F.log("close") - F.log(F.lag("close", 60).over(panel()))), "slope": F.regr_slope(F.log("close"), "k").over(c.back(20)), "template": F.col("close") > F.avg("close").over(c.back(20))})
    stage = F.when(F.col("template") & (F.col("slope") > 0), 2).when((F.col("slope") < 0) & ~F.col("template"), 4).when(F.col("prior") > 0, 3).otherwise(1)
    return d.where("prior is not null and slope is not null").select("ticker", "date", F.col("prior").cast("int").alias("prior_slope_sign"), stage.alias("stage"))


@rule("p20_lifecycle", ("bars",), """select ticker, session_id, case when exit_date is null then 'active' when date_diff('day', entry_date, exit_date) <= 10 then 'failed' when date_diff('day', entry_date, exit_date) <= 60 then 'closed' else 'matured' end as cohort from sessions""", f"{FLAGGED},\n{SESSIONS}")
def p20(spark, sf_dir):
    held = F.date_diff("exit_date", "entry_date")
    return sessions_of(spark, sf_dir).select("ticker", "session_id", se.ladder([(F.col("exit_date").isNull(), "active"), (held <= 10, "failed"), (held <= 60, "closed")], "matured").alias("cohort"))


# What error messages contain, by category, in the order in which they are tried.
ERRORS = [("RATE_LIMIT", ("rate", "429")), ("TIMEOUT", ("timeout", "timed out")), ("NO_DATA", ("no data", "empty")), ("VALIDATION", ("valid",)), ("AUTH", ("auth", "401", "403"))]


@rule("p21_error_classes", (), "select conv_id, turn, case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{k}'" for k, ws in ERRORS) + " else 'FETCH_FAILURE' end as category from conversations", "no as (select 1)")
def p21(spark, sf_dir):
    message = F.lower("text")
    rules = [(F.greatest(*[F.contains(message, F.lit(w)) for w in ws], F.lit(False)), k) for k, ws in ERRORS]
    return t.table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", se.ladder(rules, "FETCH_FAILURE").alias("category"))


@rule("p23_e_filing_dates", ("fundamentals",), "select ticker, count(*) filter (where filing_date - period_end < 40) as rejected, count(*) filter (where filing_date - period_end >= 40) as kept from fundamentals group by ticker")
def p23(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir).withColumn("clean", F.when(F.date_diff("filing_date", "period_end") >= 40, F.col("filing_date")))
    return f.groupBy("ticker").agg(F.count_if(F.col("clean").isNull() & F.col("filing_date").isNotNull()).alias("rejected"), F.count("clean").alias("kept"))


@rule("p24_share_counts", ("bars", "shares"), "select ticker, date, case when shares_outstanding <= 1000000 then shares_outstanding end as shares_outstanding from shares")
def p24(spark, sf_dir):
    return t.shares(spark, sf_dir).select("ticker", "date", F.when(F.col("shares_outstanding") <= 1000000, F.col("shares_outstanding")).alias("shares_outstanding"))


@rule("p26_after_listing", ("bars",), f"select ticker, date, {r('close')} as close from bars join (select ticker as tk, min(date) filter (where volume >= 30) as listed from bars group by ticker) on tk = ticker and date >= listed where close > 0 and date >= date '1970-01-01'")
def p26(spark, sf_dir):
    b = t.bars(spark, sf_dir)
    listed = F.min(F.when(F.col("volume") >= 30, F.col("date"))).over(Window.partitionBy("ticker"))
    return b.withColumn("listed", listed).where("date >= listed and close > 0 and date >= date'1970-01-01'").select("ticker", "date", "close")


@rule("p28_name_patterns", ("profiles",), "select ticker, industry from profiles where industry like '%A%' and length(industry) between 5 and 14 and lower(ticker) not like '%7%'")
def p28(spark, sf_dir):
    return t.profiles(spark, sf_dir).where(F.col("industry").like("%A%") & F.length("industry").between(5, 14) & ~F.lower("ticker").contains("7")).select("ticker", "industry")


# ---- joins

@rule("j6_latest_by_maximum", ("bars", "shares"), "select b.ticker, b.date, (select max(s.date) from shares s where s.ticker = b.ticker and s.date <= b.date) as as_of from bars b")
def j6(spark, sf_dir):
    right = t.shares(spark, sf_dir).select("ticker", F.col("date").alias("as_of"))
    return j.asof(t.bars(spark, sf_dir).select("ticker", "date"), right, "ticker", "date", "as_of", ["as_of"])


@rule("j12_in_session", ("bars",), "select b.ticker, b.date, count(s.session_id) as sessions from bars b left join sessions s on s.ticker = b.ticker and b.date between entry_date and coalesce(exit_date, date '9999-12-31') group by 1, 2", f"{FLAGGED},\n{SESSIONS}")
def j12(spark, sf_dir):
    days = t.bars(spark, sf_dir).select("ticker", "date")
    met = j.interval_join(days, sessions_of(spark, sf_dir), "ticker", "date", "entry_date", "exit_date", closed=True).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(met, ["ticker", "date"], "left").select("ticker", "date", F.coalesce("n", F.lit(0)).alias("sessions"))


@rule("j13_grace_priority", ("bars",), """select ticker, date, session_id, state from (select b.ticker, b.date, session_id, case when exit_date is null or b.date <= exit_date then 'active' else 'removed' end as state,
row_number() over (partition by b.ticker, b.date order by case when exit_date is null or b.date <= exit_date then 0 else 1 end, session_id desc) as k
from bars b join sessions s on s.ticker = b.ticker and b.date >= entry_date and (exit_date is null or b.date <= exit_date + 30)) where k = 1""", f"{FLAGGED},\n{SESSIONS}")
def j13(spark, sf_dir):
    s = sessions_of(spark, sf_dir).withColumn("until", F.date_add("exit_date", 30))
    d = j.interval_join(t.bars(spark, sf_dir).select("ticker", "date"), s, "ticker", "date", "entry_date", "until", closed=True)
    d = d.withColumn("state", F.when(F.col("exit_date").isNull() | (F.col("date") <= F.col("exit_date")), "active").otherwise("removed"))
    return j.latest_per_key(d, ["ticker", "date"], [F.asc("state"), F.desc("session_id")]).select("ticker", "date", "session_id", "state")


# ---- aggregates over trades

PATHS = """paths as (select s.ticker, session_id, entry_date, b.date, b.close, row_number() over w as day, first_value(b.close) over w as entry, max(b.close) over w as peak
from sessions s join bars b on b.ticker = s.ticker and b.date >= entry_date and (exit_date is null or b.date <= exit_date) window w as (partition by s.ticker, session_id order by b.date))"""
ON_TRADES = f"{FLAGGED},\n{SESSIONS},\n{PATHS}"


def paths(spark, sf_dir):
    d = j.interval_join(t.bars(spark, sf_dir).select("ticker", "date", "close"), sessions_of(spark, sf_dir), "ticker", "date", "entry_date", "exit_date", closed=True)
    w = Window.partitionBy("ticker", "session_id").orderBy("date")
    return d.select("ticker", "session_id", "entry_date", "date", "close", F.row_number().over(w).alias("day"), F.first("close").over(w).alias("entry"), F.max("close").over(w).alias("peak"))


@rule("a10_trade_stats", ("bars",), f"select ticker, session_id, {r('mfe')} as mfe, {r('mae')} as mae, {r('mfe / nullif(abs(mae), 0)')} as e_ratio, {r('mfe - last')} as regret from (select ticker, session_id, max(close) / min(entry) - 1 as mfe, min(close) / min(entry) - 1 as mae, arg_max(close, date) / min(entry) - 1 as last from paths group by 1, 2)", ON_TRADES)
def a10(spark, sf_dir):
    g = paths(spark, sf_dir).groupBy("ticker", "session_id").agg((F.max("close") / F.min("entry") - 1).alias("mfe"), (F.min("close") / F.min("entry") - 1).alias("mae"), (F.max_by("close", "date") / F.min("entry") - 1).alias("last"))
    return g.select("ticker", "session_id", "mfe", "mae", c.safe_ratio("mfe", F.abs("mae")).alias("e_ratio"), (F.col("mfe") - F.col("last")).alias("regret"))


@rule("a11_time_to_peak", ("bars",), f"select ticker, session_id, arg_min(day, (-close, date)) as days_to_peak, {r('1 - arg_max(close, date) / max(close)')} as fade, count(*) - arg_min(day, (-close, date)) as held_after_peak from paths group by 1, 2", ON_TRADES)
def a11(spark, sf_dir):
    peak = F.min_by("day", F.struct(-F.col("close"), F.col("date")))
    return paths(spark, sf_dir).groupBy("ticker", "session_id").agg(peak.alias("days_to_peak"), (1 - F.max_by("close", "date") / F.max("close")).alias("fade"), (F.count(F.lit(1)) - peak).alias("held_after_peak"))


@rule("a12_failures", ("bars",), f"select ticker, session_id, min(day) filter (where close < entry * 0.95) as first_day_below, {r('min(close / peak - 1)')} as max_drawdown from paths group by 1, 2", ON_TRADES)
def a12(spark, sf_dir):
    return paths(spark, sf_dir).groupBy("ticker", "session_id").agg(F.min(F.when(F.col("close") < F.col("entry") * 0.95, F.col("day"))).alias("first_day_below"), F.min(F.col("close") / F.col("peak") - 1).alias("max_drawdown"))


@rule("a13_event_path", ("bars",), f"select day, count(*) as trades, {r('avg(close / entry - 1)')} as mean_path from paths where day <= 20 group by day", ON_TRADES)
def a13(spark, sf_dir):
    return paths(spark, sf_dir).where("day <= 20").groupBy("day").agg(F.count(F.lit(1)).alias("trades"), F.avg(F.col("close") / F.col("entry") - 1).alias("mean_path"))


@rule("a14_winners_losers", ("bars",), f"select x > 0 as winner, count(*) as trades, {r('avg(x)')} as mean_return, {r('min(x)')} as worst, {r('max(x)')} as best from (select arg_max(close, date) / min(entry) - 1 as x from paths group by ticker, session_id) group by 1", ON_TRADES)
def a14(spark, sf_dir):
    g = paths(spark, sf_dir).groupBy("ticker", "session_id").agg((F.max_by("close", "date") / F.min("entry") - 1).alias("x"))
    return g.groupBy((F.col("x") > 0).alias("winner")).agg(F.count(F.lit(1)).alias("trades"), F.avg("x").alias("mean_return"), F.min("x").alias("worst"), F.max("x").alias("best"))


@rule("b8_stop_loss", ("bars",), f"""select ticker, session_id, min(date) filter (where close <= entry * 0.9) as breach_date, arg_min(next_date, date) filter (where close <= entry * 0.9) as fill_date,
{r('coalesce(arg_min(coalesce(next_close, close), date) filter (where close <= entry * 0.9), arg_max(close, date)) / min(entry) - 1')} as pnl
from (select *, lead(date) over (partition by ticker, session_id order by date) as next_date, lead(close) over (partition by ticker, session_id order by date) as next_close from paths) group by 1, 2""", ON_TRADES)
def b8(spark, sf_dir):
    w = Window.partitionBy("ticker", "session_id").orderBy("date")
    d = paths(spark, sf_dir).withColumns({"next_date": F.lead("date").over(w), "next_close": F.lead("close").over(w)})
    breach = F.min(F.when(F.col("close") <= F.col("entry") * 0.9, F.struct("date", "next_date", F.coalesce("next_close", "close").alias("fill"))))
    g = d.groupBy("ticker", "session_id").agg(breach.alias("x"), F.max_by("close", "date").alias("last"), F.min("entry").alias("entry"))
    return g.select("ticker", "session_id", F.col("x.date").alias("breach_date"), F.col("x.next_date").alias("fill_date"), (F.coalesce("x.fill", "last") / F.col("entry") - 1).alias("pnl"))


@rule("a19_cash", ("fills",), f"select ticker, {r('1000000 + sum(case when side = $$SELL$$ then quantity * price else -quantity * price end) - sum(fees)')} as cash from fills group by ticker".replace("$$SELL$$", "'SELL'"))
def a19(spark, sf_dir):
    flow = F.col("quantity") * F.col("price")
    return t.fills(spark, sf_dir).groupBy("ticker").agg((1000000 + F.sum(F.when(F.col("side") == "SELL", flow).otherwise(-flow)) - F.sum("fees")).alias("cash"))


@rule("a21_coverage_by_year", ("fundamentals",), f"select year(period_end) as y, {r('100.0 * count(nullif(net_income > 0, false)) / count(*)')} as net_income_pct, {r('100.0 * count(revenue) / count(*)')} as revenue_pct, {r('quantile_cont(revenue, 0.5)')} as p50, {r('quantile_cont(revenue, 0.9)')} as p90 from fundamentals group by 1")
def a21(spark, sf_dir):
    share = lambda x: 100.0 * F.count(x) / F.count(F.lit(1))
    p = lambda q: F.percentile("revenue", F.lit(q))
    return t.fundamentals(spark, sf_dir).groupBy(F.year("period_end").cast("long").alias("y")).agg(share(F.when(F.col("net_income") > 0, F.lit(1))).alias("net_income_pct"), share("revenue").alias("revenue_pct"), p(0.5).alias("p50"), p(0.9).alias("p90"))


HORIZONS = (5, 20)


@rule("a23_horizon_stats", ("bars",), " union all ".join(f"select {h} as horizon, count(x) as n, {r('100 * avg(x)')} as mean, {r('100 * median(x)')} as median, {r('100 * min(x)')} as worst, {r('100 * max(x)')} as best, {r('100 * stddev_samp(x)')} as std from (select lead(close, {h}) {LINE} / close - 1 as x from bars)" for h in HORIZONS))
def a23(spark, sf_dir):
    names = [f"r{h}" for h in HORIZONS]
    d = t.bars(spark, sf_dir).select(*[(F.lead("close", h).over(panel()) / F.col("close") - 1).alias(f"r{h}") for h in HORIZONS])
    parts = (("n", F.count), ("mean", F.avg), ("worst", F.min), ("best", F.max), ("std", F.stddev_samp))
    one = d.agg(*[f(x).alias(f"{n}_{x}") for x in names for n, f in parts]).crossJoin(F.broadcast(exact_quantiles(d, names, [0.5])))  # one row
    row = lambda h, x: F.struct(F.lit(h).alias("horizon"), F.col(f"n_{x}").alias("n"), *[(100 * v).alias(n) for n, v in (("mean", F.col(f"mean_{x}")), ("median", F.col(x)[0]), ("worst", F.col(f"worst_{x}")), ("best", F.col(f"best_{x}")), ("std", F.col(f"std_{x}")))])
    return one.select(F.inline(F.array(*[row(h, x) for h, x in zip(HORIZONS, names, strict=True)])))


@rule("a24_class_balance", (), f"select quality as cls, count(*) as n, {r('count(*) * 1.0 / sum(count(*)) over ()')} as share, {r('max(count(*)) over () * 1.0 / count(*)')} as imbalance from labels group by quality", "no as (select 1)")
def a24(spark, sf_dir):
    per = t.table(spark, sf_dir, "labels", "quality").groupBy(F.col("quality").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(1))  # one row a class
    return per.select("cls", "n", (F.col("n") / F.sum("n").over(every)).alias("share"), (F.max("n").over(every) / F.col("n")).alias("imbalance"))


@rule("a25_days_active_by_class", ("bars",), f"select x > 0 as winner, {r('avg(days)')} as mean_days, max(days) as most_days from (select arg_max(close, date) / min(entry) - 1 as x, count(*) as days from paths group by ticker, session_id) group by 1", ON_TRADES)
def a25(spark, sf_dir):
    g = paths(spark, sf_dir).groupBy("ticker", "session_id").agg((F.max_by("close", "date") / F.min("entry") - 1).alias("x"), F.count(F.lit(1)).alias("days"))
    return g.groupBy((F.col("x") > 0).alias("winner")).agg(F.avg("days").alias("mean_days"), F.max("days").alias("most_days"))


@rule("a27_trend_counts", ("bars",), "select date, count(*) as n, count(*) filter (where close > s5 and close > s15) as up, count(*) filter (where breakout_ok) as breakouts from flagged group by date", FLAGGED)
def a27(spark, sf_dir):
    return flagged(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("close") > F.col("s5")) & (F.col("close") > F.col("s15"))).alias("up"), F.count_if("breakout_ok").alias("breakouts"))


FWD = f"fw as (select *, lead(close, 5) {LINE} / close - 1 as fwd from scores)"


def with_forward(spark, sf_dir):
    return t.scores(spark, sf_dir).withColumn("fwd", F.lead("close", 5).over(panel()) / F.col("close") - 1)


@rule("a29_negative_filter", ("scores",), f"select {r('avg(cast(fwd <= 0 as int)) filter (where score < 0.3)')} as npv, {r('avg(cast(fwd > 0 as int)) filter (where score >= 0.3)')} as win_rate, {r('avg(cast(fwd < -0.1 as int)) filter (where score < 0.3)')} as toxic_under, {r('avg(cast(fwd < -0.1 as int)) filter (where score >= 0.3)')} as toxic_over from fw where fwd is not null", FWD)
def a29(spark, sf_dir):
    share = lambda side, what: F.avg(F.when(side, what.cast("int")))
    low, high, x = F.col("score") < 0.3, F.col("score") >= 0.3, F.col("fwd")
    return with_forward(spark, sf_dir).where("fwd is not null").agg(share(low, x <= 0).alias("npv"), share(high, x > 0).alias("win_rate"), share(low, x < -0.1).alias("toxic_under"), share(high, x < -0.1).alias("toxic_over"))


@rule("a30_weighted_winsorised_mean", ("fundamentals",), f"""select m, {r('sum(least(greatest(x, lo), hi) * w) / sum(w)')} as mean from (select period_end as m, net_income / revenue as x, total_equity as w from fundamentals where revenue > 0)
join (select period_end as m2, quantile_cont(net_income / revenue, 0.05) as lo, quantile_cont(net_income / revenue, 0.95) as hi from fundamentals where revenue > 0 group by 1) on m = m2 group by m""")
def a30(spark, sf_dir):
    d = t.fundamentals(spark, sf_dir).where("revenue > 0").select(F.col("period_end").alias("m"), (F.col("net_income") / F.col("revenue")).alias("x"), F.col("total_equity").alias("w"))
    limits = d.groupBy("m").agg(F.percentile("x", F.array(F.lit(0.05), F.lit(0.95))).alias("q"))
    x = F.least(F.greatest("x", F.col("q")[0]), F.col("q")[1])
    return d.join(limits, "m").groupBy("m").agg((F.sum(x * F.col("w")) / F.sum("w")).alias("mean"))


# ---- series

SPANS = (8, 21, 50, 100, 200)
EMA = "bn as (select ticker, date, close, row_number() over (partition by ticker order by date) as k from bars),\nem as (select ticker, date, k, " + ", ".join(f"close as ema_{n}" for n in SPANS) + " from bn where k = 1 union all select b.ticker, b.date, b.k, " + ", ".join(f"b.close * (2.0e0 / {n + 1}) + e.ema_{n} * (1 - 2.0e0 / {n + 1})" for n in SPANS) + " from em e join bn b on b.ticker = e.ticker and b.k = e.k + 1)"


@rule("w19_ema", ("bars",), "select ticker, date, " + ", ".join(f"{r(f'ema_{n}')} as ema_{n}" for n in SPANS) + " from em", EMA)
def w19(spark, sf_dir):
    return se.ema(t.bars(spark, sf_dir, lines=True).select("ticker", "date", "close"), "ticker", "date", "close", SPANS).drop("close")


T2_SQL = {
    "sma_20": f"avg(close) {over(20)}", "sma_50": f"avg(close) {over(50)}", "sma_150": f"avg(close) {over(150)}", "sma_200": f"avg(close) {over(200)}", "vol_avg_50": f"avg(volume) {over(50)}",
    "high_52w": f"max(close) {over(252)}", "low_52w": f"min(close) {over(252)}", "mom_21d": f"close / nullif(lag(close, 21) {LINE}, 0) - 1", "mom_63d": f"close / nullif(lag(close, 63) {LINE}, 0) - 1",
    "return_1d": f"close / nullif(lag(close) {LINE}, 0) - 1",
}
V1_FINAL = {"price_vs_sma_50": "close / nullif(sma_50, 0) - 1", "dist_from_52w_high": "close / nullif(high_52w, 0) - 1", "ema_ratio_8_21": "ema_8 / nullif(ema_21, 0)", "ema_ratio_50_200": "ema_50 / nullif(ema_200, 0)"}


@rule("v1_screener_features", ("bars",), "select ticker, date, volume, " + ", ".join(f"{r(n)} as {n}" for n in ["close"] + [f"ema_{n}" for n in SPANS] + list(T2_SQL)) + ", " + ", ".join(f"{r(x)} as {n}" for n, x in V1_FINAL.items())
      + f", coalesce(close > sma_50 and sma_50 > sma_150 and close > 1.3 * low_52w and close > 0.85 * high_52w, false) as trend_ok, {r('percent_rank() over (partition by date order by mom_63d nulls first)')} as mom_rank from (select b.*, " + ", ".join(f"{x} as {n}" for n, x in T2_SQL.items())
      + " from bars b) join em using (ticker, date)", EMA)
def v1(spark, sf_dir):
    """The screener table in one layout by ticker (averages, extremes, momentum, EMAs), then one by day for the rank."""
    w, close = panel(), F.col("close")
    d = t.bars(spark, sf_dir, lines=True).select("ticker", "date", "close", "volume")
    d = d.select("*", *[(close / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1).alias(m) for m, n in (("mom_21d", 21), ("mom_63d", 63), ("return_1d", 1))])
    rolls = {f"sma_{n}": ("close", "mean", n) for n in (20, 50, 150, 200)} | {"vol_avg_50": ("volume", "mean", 50), "high_52w": ("close", "max", 252), "low_52w": ("close", "min", 252)}
    d = se.rolled(d, "ticker", "date", rolls, SPANS, dealt=True).repartition(t.parts(spark, sf_dir), "date")
    trend = (close > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_150")) & (close > 1.3 * F.col("low_52w")) & (close > 0.85 * F.col("high_52w"))
    rank = F.percent_rank().over(Window.partitionBy("date").orderBy(F.asc_nulls_first("mom_63d")))
    return d.select("*", (c.safe_ratio("close", "sma_50") - 1).alias("price_vs_sma_50"), (c.safe_ratio("close", "high_52w") - 1).alias("dist_from_52w_high"), c.safe_ratio("ema_8", "ema_21").alias("ema_ratio_8_21"), c.safe_ratio("ema_50", "ema_200").alias("ema_ratio_50_200"),
                    F.coalesce(trend, F.lit(False)).alias("trend_ok"), rank.alias("mom_rank"))


NET = "nets as (select date, a / 1000 - b / 1000 - x as net, cast(row_number() over (order by date) as double) as k from filled)"


@rule("w22_m5_liquidity_pillar", ("macro",), f"select date, {r('slope')} as slope, {r('50 + 50 * tanh(50 * slope / nullif(abs(net), 0))')} as liquidity from (select *, case when count(net) over w = 20 then regr_slope(net, k) over w end as slope from nets window w as (order by date rows between 19 preceding and current row))", f"{WIDE},\n{NET}")
def m5(spark, sf_dir):
    w = day_line().rowsBetween(-19, 0)
    d = filled(spark, sf_dir).select("date", (F.col("a") / 1000 - F.col("b") / 1000 - F.col("x")).alias("net"), F.row_number().over(day_line()).cast("double").alias("k"))
    d = d.withColumn("slope", F.when(F.count("net").over(w) == 20, F.regr_slope("net", "k").over(w)))
    return d.select("date", "slope", (50 + 50 * F.tanh(50 * c.safe_ratio("slope", F.abs("net")))).alias("liquidity"))


THREE = f"""lines as (select *, cast(row_number() over (order by date) as double) as k from filled),
three as (select date, 50 + 50 * tanh(10 * (a / avg(a) over (order by date rows between 199 preceding and current row) - 1)) as trend, 50 + 50 * tanh(50 * case when count(b) over (order by date rows between 19 preceding and current row) = 20 then regr_slope(b, k) over (order by date rows between 19 preceding and current row) end / nullif(abs(b), 0)) as liquidity,
(coalesce(least(greatest(1 - (b - 40000) / 120000, 0), 1), 1) + coalesce(least(greatest(1 - (x - 40000) / 120000, 0), 1), 1)) * 50 as risk from lines)"""


@rule("m4_m5_m6_m7_composite", ("macro",), f"select date, {r('risk')} as risk, {r('round(s + 3.7e-7, 1)')} as score, case when s >= 80 then 'strong' when s >= 60 then 'good' when s >= 40 then 'neutral' when s >= 20 then 'weak' else 'poor' end as category from (select *, least(greatest(0.4 * trend + 0.3 * liquidity + 0.3 * risk, 0), 100) as s from three where trend is not null and liquidity is not null)", f"{WIDE},\n{THREE}")
def m7_whole(spark, sf_dir):
    d = filled(spark, sf_dir).withColumn("k", F.row_number().over(day_line()).cast("double"))
    part = lambda x: F.coalesce(c.clip(1 - (F.col(x) - 40000) / 120000, 0.0, 1.0), F.lit(1.0))
    trend = 50 + 50 * F.tanh(10 * (F.col("a") / F.avg("a").over(day_line().rowsBetween(-199, 0)) - 1))
    last = day_line().rowsBetween(-19, 0)
    slope = F.when(F.count("b").over(last) == 20, F.regr_slope("b", "k").over(last))
    d = d.select("date", trend.alias("trend"), (50 + 50 * F.tanh(50 * slope / F.nullif(F.abs("b"), F.lit(0.0)))).alias("liquidity"), ((part("b") + part("x")) * 50).alias("risk"))
    d = d.withColumn("s", c.clip(0.4 * F.col("trend") + 0.3 * F.col("liquidity") + 0.3 * F.col("risk"), 0.0, 100.0)).where("trend is not null and liquidity is not null")
    label = c.threshold_label(F.col("s"), [(80, "strong"), (60, "good"), (40, "neutral"), (20, "weak")], "poor")
    return d.select("date", "risk", F.round(F.col("s") + F.lit(3.7e-7), 1).alias("score"), label.alias("category"))


@rule("m3_publication_lag", ("macro",), f"select cast(date + 1 as date) as date, symbol, {r('close')} as close from macro")
def m3(spark, sf_dir):
    return t.macro(spark, sf_dir).select(F.date_add("date", 1).alias("date"), "symbol", "close")


@rule("w43_normalised_scores", ("scores",), f"select ticker, date, {r('case when hi = lo then 50.0 else 100 * (score - lo) / (hi - lo) end')} as x from scores, (select min(score) as lo, max(score) as hi from scores)")
def w43(spark, sf_dir):
    d = t.scores(spark, sf_dir)
    ends = d.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))  # one row
    x = F.when(F.col("hi") == F.col("lo"), F.lit(50.0)).otherwise(100 * (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return d.crossJoin(F.broadcast(ends)).select("ticker", "date", x.alias("x"))


@rule("w44_bars_held", ("bars",), "select ticker, session_id, date, day - 1 as bars_held from paths", ON_TRADES)
def w44(spark, sf_dir):
    return paths(spark, sf_dir).select("ticker", "session_id", "date", (F.col("day") - 1).alias("bars_held"))


# ---- fundamentals, writes, checks

@rule("e7_stale_reports", ("fundamentals",), "select ticker, max(period_end) as latest from fundamentals where revenue >= 1000000 group by ticker having max(period_end) < (select max(period_end) from fundamentals) - 100")
def e7(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir)
    latest = f.where("revenue >= 1000000").groupBy("ticker").agg(F.max("period_end").alias("latest"))
    return latest.crossJoin(F.broadcast(f.agg(F.max("period_end").alias("now")))).where(F.col("latest") < F.date_sub("now", 100)).select("ticker", "latest")  # one row


@rule("e8_earnings_soon", ("bars", "fundamentals"), "select b.ticker, b.date, coalesce(date_diff('day', b.date, f.d) <= 7, false) as soon from bars b asof left join (select ticker, filing_date as d from fundamentals) f on f.ticker = b.ticker and f.d >= b.date")
def e8(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir).select("ticker", F.col("filing_date").alias("d"))
    d = j.asof(t.bars(spark, sf_dir).select("ticker", "date"), f, "ticker", "date", "d", ["d"], forward=True)
    return d.select("ticker", "date", F.coalesce(F.date_diff("d", "date") <= 7, F.lit(False)).alias("soon"))


@rule("k10_insert_count", ("bars",), "select count(*) as inserted from (select ticker, date from bars where date >= date '1998-01-01') n where not exists (select 1 from bars o where o.ticker = n.ticker and o.date = n.date and o.date < date '1998-06-01')")
def k10(spark, sf_dir):
    b = t.bars(spark, sf_dir)
    old, new = b.where("date < '1998-06-01'"), b.where("date >= '1998-01-01'")
    return wr.purge(new, old, ["ticker", "date"]).agg(F.count(F.lit(1)).alias("inserted"))


@rule("k17_shares_backfill", ("bars", "shares"), "select s.ticker, s.date, s.shares_outstanding from shares s join (select ticker, min(date) as first from shares where date >= date '1996-01-01' group by ticker) v on v.ticker = s.ticker and s.date < v.first")
def k17(spark, sf_dir):
    s = t.shares(spark, sf_dir)
    vendor = s.where("date >= '1996-01-01'").groupBy("ticker").agg(F.min("date").alias("first"))
    return s.join(vendor, "ticker").where("date < first").select("ticker", "date", "shares_outstanding")


@rule("k18_macro_gaps", ("bars", "bench", "macro"), f"select b.date, {r('b.spy_close')} as close from bench b where not exists (select 1 from macro m where m.date = b.date and m.symbol = '1-URGENT')")
def k18(spark, sf_dir):
    have = t.macro(spark, sf_dir).where("symbol = '1-URGENT'").select("date")
    return t.benchmark_series(spark, sf_dir).join(have, "date", "left_anti").select("date", F.col("spy_close").alias("close"))


@rule("c6_close_checks", ("bars",), "select ticker, count(*) filter (where close is null or close <= 0) as bad, count(*) filter (where volume = 0) as idle, count(*) filter (where abs(close) > 1800) as absurd from bars group by ticker")
def c6(spark, sf_dir):
    return t.bars(spark, sf_dir).groupBy("ticker").agg(F.count_if(F.col("close").isNull() | (F.col("close") <= 0)).alias("bad"), F.count_if(F.col("volume") == 0).alias("idle"), F.count_if(F.abs("close") > 1800).alias("absurd"))


@rule("c11_filing_integrity", ("fundamentals",), f"select {r('100.0 * count(*) filter (where filing_date is null) / count(*)')} as null_pct, count(*) filter (where filing_date < period_end) as before_end, count(*) filter (where filing_date > period_end + 50) as late from fundamentals")
def c11(spark, sf_dir):
    late = F.col("filing_date") > F.date_add("period_end", 50)
    return t.fundamentals(spark, sf_dir).agg((100.0 * F.count_if(F.col("filing_date").isNull()) / F.count(F.lit(1))).alias("null_pct"), F.count_if(F.col("filing_date") < F.col("period_end")).alias("before_end"), F.count_if(late).alias("late"))


@rule("c12_macro_gaps", ("bars", "macro"), "select s.symbol, count(*) as missing from (select distinct symbol from macro) s, (select distinct date from bars) d where not exists (select 1 from macro m where m.symbol = s.symbol and m.date = d.date) group by s.symbol")
def c12(spark, sf_dir):
    m, days = t.macro(spark, sf_dir), t.bars(spark, sf_dir).select("date").distinct()
    wanted = days.crossJoin(F.broadcast(m.select("symbol").distinct()))  # a handful of series
    return wanted.join(m, ["date", "symbol"], "left_anti").groupBy("symbol").agg(F.count(F.lit(1)).alias("missing"))


@rule("c13_implied_cap", ("bars", "shares"), f"select b.ticker, {r('max(close * shares_outstanding)')} as top_cap, count(*) filter (where close * shares_outstanding > 1e9) as absurd from bars b join shares s on s.ticker = b.ticker and s.date = cast(last_day(date_trunc('quarter', b.date) + interval 2 month) as date) group by 1")
def c13(spark, sf_dir):
    s = t.shares(spark, sf_dir).withColumnRenamed("date", "quarter")
    b = t.bars(spark, sf_dir).withColumn("quarter", F.last_day(F.add_months(F.date_trunc("quarter", "date").cast("date"), 2)))
    cap = F.col("close") * F.col("shares_outstanding")
    return b.join(s, ["ticker", "quarter"]).groupBy("ticker").agg(F.max(cap).alias("top_cap"), F.count_if(cap > 1e9).alias("absurd"))


@rule("c15_membership_checks", ("bars",), "select count(*) filter (where exit_date <= entry_date) as exits_before, count(*) filter (where exit_date is null) as open, count(*) as n from sessions", f"{FLAGGED},\n{SESSIONS}")
def c15(spark, sf_dir):
    return sessions_of(spark, sf_dir).agg(F.count_if(F.col("exit_date") <= F.col("entry_date")).alias("exits_before"), F.count_if(F.col("exit_date").isNull()).alias("open"), F.count(F.lit(1)).alias("n"))


@rule("c19_day_coverage", ("bars", "profiles"), f"select d.date, {r('100.0 * count(distinct b.ticker) / (select count(*) from profiles where is_active)')} as coverage_pct from (select distinct date from bars) d left join (select b.* from bars b join profiles p on p.ticker = b.ticker and is_active) b on b.date = d.date group by 1")
def c19(spark, sf_dir):
    b, active = t.bars(spark, sf_dir).select("ticker", "date"), t.profiles(spark, sf_dir).where("is_active").select("ticker", F.lit(1).alias("one"))
    n = active.agg(F.count(F.lit(1)).alias("n"))  # one row
    per = b.join(active, "ticker", "left").groupBy("date").agg(F.count_distinct(F.when(F.col("one").isNotNull(), F.col("ticker"))).alias("k"))
    return per.crossJoin(F.broadcast(n)).select("date", (100.0 * F.col("k") / F.col("n")).alias("coverage_pct"))


@rule("c20_plausibility", ("bars",), "select count(*) filter (where close > 1e6) as price, count(*) filter (where volume > 1e12) as volume, count(*) filter (where high < low) as inverted, count(*) filter (where close > high * 1.0001 or close < low * 0.9999) as outside, count(*) filter (where date > date '2100-01-01') as future from bars")
def c20(spark, sf_dir):
    checks = {"price": "close > 1e6", "volume": "volume > 1e12", "inverted": "high < low", "outside": "close > high * 1.0001 or close < low * 0.9999", "future": "date > date'2100-01-01'"}
    return t.bars(spark, sf_dir).agg(*[F.count_if(F.expr(x)).alias(n) for n, x in checks.items()])


@rule("c23_frame_gate", ("bars",), " union all ".join(f"select '{n}' as col, count(*) filter (where {n} is null) * 2 > count(*) as mostly_null, coalesce(stddev_samp({n}) = 0, true) as constant from bars" for n in ("open", "close", "volume")))
def c23(spark, sf_dir):
    names = ("open", "close", "volume")
    one = t.bars(spark, sf_dir).agg(*[F.struct(F.lit(n).alias("col"), (F.count_if(F.col(n).isNull()) * 2 > F.count(F.lit(1))).alias("mostly_null"), F.coalesce(F.stddev_samp(n) == 0, F.lit(True)).alias("constant")).alias(n) for n in names])
    return one.select(F.inline(F.array(*names)))


@rule("c27_status_canary", (), "select event_type as status, count(*) as n from events where event_type not in ('click', 'view') group by 1", "no as (select 1)")
def c27(spark, sf_dir):
    return t.table(spark, sf_dir, "events", "event_type").where(~F.col("event_type").isin("click", "view")).groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@rule("c28_trade_set_diff", ("bars",), "select coalesce(a.ticker, b.ticker) as ticker, coalesce(a.entry_date, b.entry_date) as entry_date, case when b.ticker is null then 'only_old' when a.ticker is null then 'only_new' when a.exit_date is distinct from b.exit_date then 'changed' end as state from sessions a full join (select ticker, entry_date, case when session_id = 2 then null else exit_date end as exit_date from sessions where session_id <> 1) b on a.ticker = b.ticker and a.entry_date = b.entry_date where b.ticker is null or a.ticker is null or a.exit_date is distinct from b.exit_date", f"{FLAGGED},\n{SESSIONS}")
def c28(spark, sf_dir):
    old = sessions_of(spark, sf_dir)
    new = old.where("session_id <> 1").select("ticker", "entry_date", F.when(F.col("session_id") != 2, F.col("exit_date")).alias("new_exit"), F.lit(1).alias("b"))
    d = old.select("ticker", "entry_date", "exit_date", F.lit(1).alias("a")).join(new, ["ticker", "entry_date"], "full_outer")
    state = se.ladder([(F.col("b").isNull(), "only_old"), (F.col("a").isNull(), "only_new"), (~F.col("exit_date").eqNullSafe(F.col("new_exit")), "changed")])
    return d.select("ticker", "entry_date", state.alias("state")).where("state is not null")


# ---- text

@rule("x5_canonical_names", (), r"""select n_name as name, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(n_name || ' Holdings, Inc. (US)'), '\([^)]*\)', ' ', 'g'), '\b(incorporated|inc|corporation|corp|company|co|limited|ltd|llc|plc|sa|ag|gmbh|holdings?|group)\b\.?', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') as key from nation""", "no as (select 1)")
def x5(spark, sf_dir):
    return t.table(spark, sf_dir, "nation", "n_name").select(F.col("n_name").alias("name"), tx.canonical_key(F.concat("n_name", F.lit(" Holdings, Inc. (US)"))).alias("key"))


@rule("x3_quote_grounding", (), "select doc_id, contains(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), trim(lower(regexp_replace(substr(text, 11, 40), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) as grounded from documents where text is not null and length(text) > 60 and not regexp_matches(text, '[‘’“”–—…]|[.]{3}')", "no as (select 1)")
def x3(spark, sf_dir):
    d = t.table(spark, sf_dir, "documents", "doc_id", "text").where("length(text) > 60").where(~F.col("text").rlike("[‘’“”–—…]|[.]{3}"))
    return d.select("doc_id", tx.grounded(tx.normalise(F.substring("text", 11, 40)), tx.normalise(F.col("text"))).alias("grounded"))
