"""Serving views (V): session features, candidate and deployment pools, watchlists, positions, risk, macro boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import panel
from barsmith.operators import joins as j
from barsmith.operators import quality as q
from barsmith.operators import sessions as se
from barsmith.operators import trades as tr
from barsmith.plans.base import LINE, ORACLE_SQL, QUERIES, over
from barsmith.plans.features import FLAGGED, flagged, rounded
from barsmith.plans.features import rounded_sql as r
from barsmith.plans.markets import PILLARS, WIDE, day_line, pillars
from barsmith.plans.screening import rule
from barsmith.plans.timeline import DAILY, ENTRIES, EXITS, HOLD_SQL, SESSIONS, exits_of, hold, sessions_of
from barsmith.sources import tables as t

T2 = f"t2 as ({ORACLE_SQL['v1_screener_features']})"
CHANGES = ("close", "sma_20", "sma_50", "vol_avg_50", "ema_21", "high_52w")
T3 = f"""{T2},
{FLAGGED},
{SESSIONS},
moved as (select *, {', '.join(f'({n} - lag({n}) {LINE}) / nullif(abs(lag({n}) {LINE}), 0) as {n}_delta' for n in CHANGES)} from t2),
t3 as (select m.*, s.session_id, s.entry_date, row_number() over (partition by m.ticker, s.session_id order by m.date) as day_in_session
  from moved m join sessions s on s.ticker = m.ticker and m.date >= s.entry_date and (s.exit_date is null or m.date <= s.exit_date))"""


def screener(spark, sf_dir) -> DataFrame:
    return QUERIES["v1_screener_features"](spark, sf_dir)


def moved(spark, sf_dir) -> DataFrame:
    """The screener table with changes against the bar before, as shares of the old value's size."""
    d = screener(spark, sf_dir)
    return d.select("*", *[(c.abs_change_pct(n) / 100).alias(f"{n}_delta") for n in CHANGES])


def session_features(spark, sf_dir) -> DataFrame:
    d = j.interval_join(moved(spark, sf_dir), sessions_of(spark, sf_dir), "ticker", "date", "entry_date", "exit_date", closed=True)
    day = F.row_number().over(Window.partitionBy("ticker", "session_id").orderBy("date"))
    return d.withColumn("day_in_session", day)


def last_days(d: DataFrame, days: int) -> DataFrame:
    """Rows of the table's last calendar days; its last day is a single value."""
    end = d.agg(F.max("date").alias("__end"))
    return d.crossJoin(F.broadcast(end)).where(F.col("date") > F.date_sub("__end", days)).drop("__end")


V2_COLUMNS = ["close", "sma_50", "mom_63d", "mom_rank", *[f"{n}_delta" for n in CHANGES]]


@rule("v2_session_features", ("bars", "macro"), "select ticker, session_id, date, day_in_session, trend_ok, trend > 50 as regime_up, " + ", ".join(f"{r(n)} as {n}" for n in V2_COLUMNS)
      + " from t3 left join pillars using (date)", f"{WIDE},\n{PILLARS},\n{T3}")
def v2(spark, sf_dir):
    regime = pillars(spark, sf_dir).select("date", (F.col("trend") > 50).alias("regime_up"))  # a row a day
    d = session_features(spark, sf_dir).join(regime, "date", "left")
    return d.select("ticker", "session_id", "date", "day_in_session", "trend_ok", "regime_up", *V2_COLUMNS)


def require_coverage(days: DataFrame, benchmark: DataFrame) -> DataFrame:
    """days, if the benchmark has every one of its dates; else an error that names the first missing ones."""
    missing = q.purge_dates(days, benchmark).orderBy("date").limit(5).collect()
    if missing:
        raise ValueError(f"benchmark has no row for {', '.join(str(m['date']) for m in missing)}")
    return days


@rule("v3_missing_benchmark_days", ("bars", "macro"), "select distinct date from bars where date not in (select date from macro where symbol = '1-URGENT')")
def v3(spark, sf_dir):
    benchmark = t.macro(spark, sf_dir).where("symbol = '1-URGENT'")
    return q.purge_dates(t.bars(spark, sf_dir), benchmark)


@rule("g8_candidate_trades", ("bars",), f"""select s.ticker, session_id, s.ticker || '_' || strftime(entry_date, '%Y-%m-%d') as trade_id, entry_date, exit_date, {r('b.close / a.close - 1')} as return_pct
from sessions s join bars a on a.ticker = s.ticker and a.date = entry_date left join bars b on b.ticker = s.ticker and b.date = exit_date""", f"{FLAGGED},\n{SESSIONS}")
def g8(spark, sf_dir):
    return candidates(spark, sf_dir)


def candidates(spark, sf_dir) -> DataFrame:
    """Trades of sessions: a text key, the next bar after the run as exit, the return between the two closes."""
    s, b = sessions_of(spark, sf_dir), t.bars(spark, sf_dir)
    first = b.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"))
    last = b.select("ticker", F.col("date").alias("exit_date"), F.col("close").alias("exit_close"))
    d = s.join(first, ["ticker", "entry_date"]).join(last, ["ticker", "exit_date"], "left")
    key = F.concat_ws("_", "ticker", F.date_format("entry_date", "yyyy-MM-dd"))
    return d.select("ticker", "session_id", key.alias("trade_id"), "entry_date", "exit_date", (F.col("exit_close") / F.col("entry_close") - 1).alias("return_pct"))


@rule("v5_candidates_with_features", ("bars",), f"""select s.ticker, s.session_id, s.entry_date, {r('m.mom_63d')} as mom_63d, {r('m.mom_rank')} as mom_rank, {r('m.close_delta')} as close_delta, {r('m.sma_20_delta')} as sma_20_delta
from sessions s join moved m on m.ticker = s.ticker and m.date = s.entry_date""", T3)
def v5(spark, sf_dir):
    m = moved(spark, sf_dir).withColumnRenamed("date", "entry_date")
    return sessions_of(spark, sf_dir).join(m, ["ticker", "entry_date"]).select("ticker", "session_id", "entry_date", "mom_63d", "mom_rank", "close_delta", "sma_20_delta")


@rule("v9_deployment_pool", ("bars",), f"select ticker, session_id, date, {r('close')} as close, {r('mom_rank')} as mom_rank from t3 where date > (select max(date) from t2) - 252", T3)
def v9(spark, sf_dir):
    end = t.bars(spark, sf_dir).agg(F.max("date").alias("end"))
    d = session_features(spark, sf_dir).crossJoin(F.broadcast(end)).where(F.col("date") > F.date_sub("end", 252))  # one row
    return d.select("ticker", "session_id", "date", "close", "mom_rank")


@rule("v10_pre_breakout", ("bars", "fundamentals", "shares"), f"""select b.ticker, b.date, {r('b.close')} as close, {r('f.revenue')} as revenue, sh.shares_outstanding
from (select * from flagged where coalesce(trend_ok, false) and not coalesce(breakout_ok, false) and date > (select max(date) from bars) - 365) b
asof left join (select * from fundamentals qualify row_number() over (partition by ticker, filing_date order by period_end desc) = 1) f on b.ticker = f.ticker and b.date >= f.filing_date
asof left join shares sh on b.ticker = sh.ticker and b.date >= sh.date""", FLAGGED)
def v10(spark, sf_dir):
    d = flagged(spark, sf_dir).select("ticker", "date", "close", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("trend_ok", "breakout_ok")])
    d = last_days(d, 365).where("trend_ok and not breakout_ok")
    f = j.latest_per_key(t.fundamentals(spark, sf_dir), ["ticker", "filing_date"], [F.desc("period_end")])
    d = j.asof(d, f, "ticker", "date", "filing_date", ["revenue"])
    d = j.asof(d, t.shares(spark, sf_dir), "ticker", "date", "date", ["shares_outstanding"])
    return d.select("ticker", "date", "close", "revenue", "shares_outstanding")


@rule("v12_shortlist", ("bars", "profiles"), f"""select date, ticker, sector, {r('score')} as score, case when vol_avg_50 >= 30 then 'deep' when vol_avg_50 >= 25 then 'fair' else 'thin' end as liquidity, score >= 0.5 and trend_ok as listed
from (select *, (mom_rank + percent_rank() over (partition by date order by price_vs_sma_50 nulls first)) / 2 as score from t2) join profiles using (ticker)""", T2)
def v12(spark, sf_dir):
    day = Window.partitionBy("date").orderBy(F.asc_nulls_first("price_vs_sma_50"))
    d = screener(spark, sf_dir).withColumn("score", (F.col("mom_rank") + F.percent_rank().over(day)) / 2)
    tag = c.threshold_label(F.col("vol_avg_50"), [(30, "deep"), (25, "fair")], "thin")
    listed = (F.col("score") >= 0.5) & F.col("trend_ok")
    return d.join(t.profiles(spark, sf_dir), "ticker").select("date", "ticker", "sector", "score", tag.alias("liquidity"), listed.alias("listed"))


RUNS = f"""runs_now as (select ticker, min(date) as start_date, arg_min(close, date) as start_close from (
  select *, sum(cast(not t as int)) {'over (partition by ticker order by date rows between unbounded preceding and current row)'} as island, max(date) over (partition by ticker) as last from (select *, {HOLD_SQL} as t from flagged)) where t group by ticker, island, last having max(date) = last),
latest as (select * from bars qualify row_number() over (partition by ticker order by date desc) = 1)"""


def latest_bars(spark, sf_dir) -> DataFrame:
    b = t.bars(spark, sf_dir)
    return b.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))


@rule("v13_screening", ("bars",), f"""select l.ticker, l.date, case when n.ticker is not null then 'run' when s.entry_date is not null then 'past' else 'none' end as anchor, coalesce(n.start_date, s.entry_date) as anchor_date, {r('l.close / coalesce(n.start_close, e.close) - 1')} as pct_return
from latest l left join runs_now n using (ticker) left join (select ticker, max(entry_date) as entry_date from sessions group by ticker) s using (ticker) left join bars e on e.ticker = l.ticker and e.date = s.entry_date""", f"{FLAGGED},\n{SESSIONS},\n{RUNS}")
def v13(spark, sf_dir):
    runs = se.current_runs(flagged(spark, sf_dir), hold()).select("ticker", "start_date", "start_close")
    past = sessions_of(spark, sf_dir).groupBy("ticker").agg(F.max("entry_date").alias("entry_date"))
    entry = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"))
    d = latest_bars(spark, sf_dir).join(runs, "ticker", "left").join(past, "ticker", "left").join(entry, ["ticker", "entry_date"], "left")
    anchor = F.when(F.col("start_date").isNotNull(), "run").when(F.col("entry_date").isNotNull(), "past").otherwise("none")
    since = F.coalesce("start_date", "entry_date")
    return d.select("ticker", "date", anchor.alias("anchor"), since.alias("anchor_date"), (F.col("close") / F.coalesce("start_close", "entry_close") - 1).alias("pct_return"))


@rule("v14_monitor", ("bars", "scores", "profiles"), f"""select l.ticker, l.date, p.sector, {r('s.score')} as score, case when o.n > 0 then 'held' when s.score >= 0.8 then 'watch' else 'idle' end as status
from latest l left join profiles p using (ticker) left join scores s on s.ticker = l.ticker and s.date = l.date left join (select ticker, count(*) as n from sessions where exit_date is null group by ticker) o on o.ticker = l.ticker""", f"{FLAGGED},\n{SESSIONS},\n{RUNS}")
def v14(spark, sf_dir):
    open_ = sessions_of(spark, sf_dir).where("exit_date is null").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    scores = t.scores(spark, sf_dir).select("ticker", "date", "score")
    d = latest_bars(spark, sf_dir).join(t.profiles(spark, sf_dir), "ticker", "left").join(scores, ["ticker", "date"], "left").join(open_, "ticker", "left")
    status = F.when(F.col("n") > 0, "held").when(F.col("score") >= 0.8, "watch").otherwise("idle")
    return d.select("ticker", "date", "sector", "score", status.alias("status"))


def resolved(df: DataFrame, names: list[str], derived: dict) -> DataFrame:
    """df's ticker, date and the named columns: its own, <column>_delta (change against the bar before) or derived
    from an expression; any other name is an error."""
    out = []
    for n in names:
        if n in df.columns:
            out.append(F.col(n))
        elif n in derived:
            out.append(derived[n].alias(n))
        elif n.endswith("_delta") and n[:-6] in df.columns:
            out.append((c.abs_change_pct(n[:-6]) / 100).alias(n))
        else:
            raise KeyError(n)
    return df.select("ticker", "date", *out)


@rule("v17_dense_deployment", ("bars", "fundamentals"), f"""select t2.ticker, t2.date, {r('t2.close')} as close, {r(f'(t2.sma_50 - lag(t2.sma_50) over (partition by t2.ticker order by t2.date)) / nullif(abs(lag(t2.sma_50) over (partition by t2.ticker order by t2.date)), 0)')} as sma_50_delta,
{r('f.revenue')} as revenue, {r('t2.close / nullif(t2.sma_200, 0)')} as price_to_sma_200 from t2 asof left join (select * from fundamentals qualify row_number() over (partition by ticker, filing_date order by period_end desc) = 1) f on t2.ticker = f.ticker and t2.date >= f.filing_date""", T2)
def v17(spark, sf_dir):
    """close and averages as v1_screener_features has them, made here in the one layout by ticker that the rest needs."""
    f = j.latest_per_key(t.fundamentals(spark, sf_dir), ["ticker", "filing_date"], [F.desc("period_end")])
    means = {f"sma_{n}": F.avg("close").over(c.back(n)) for n in (50, 200)}
    d = t.bars(spark, sf_dir, lines=True).select("ticker", "date", rounded(F.col("close")).alias("close"), *[rounded(x).alias(n) for n, x in means.items()])
    d = resolved(d, ["close", "sma_50_delta", "price_to_sma_200"], {"price_to_sma_200": c.safe_ratio("close", "sma_200")})
    return j.asof_few(d, f, "ticker", "date", "filing_date", ["revenue"]).select("ticker", "date", "close", "sma_50_delta", "revenue", "price_to_sma_200")


@rule("v18_entry_pool", ("bars",), f"select ticker, session_id, date, {r('close')} as close, {r('mom_63d')} as mom_63d from t3 where date = entry_date", T3)
def v18(spark, sf_dir):
    return session_features(spark, sf_dir).where("date = entry_date").select("ticker", "session_id", "date", "close", "mom_63d")


@rule("v21_scored_watchlist", ("bars", "scores"), f"""select s.ticker, session_id, 'open' as kind, l.date, {r('c.score')} as score from sessions s join latest l using (ticker) left join scores c on c.ticker = s.ticker and c.date = l.date where exit_date is null
union all select s.ticker, session_id, 'exit', exit_date, {r('c.score')} from sessions s left join scores c on c.ticker = s.ticker and c.date = exit_date where exit_date > (select max(date) from bars) - 90""", f"{FLAGGED},\n{SESSIONS},\n{RUNS}")
def v21(spark, sf_dir):
    s, last = sessions_of(spark, sf_dir), latest_bars(spark, sf_dir).select("ticker", "date")
    end = last.agg(F.max("date").alias("end"))
    open_ = s.where("exit_date is null").join(last, "ticker").select("ticker", "session_id", F.lit("open").alias("kind"), "date")
    gone = s.crossJoin(F.broadcast(end)).where(F.col("exit_date") > F.date_sub("end", 90)).select("ticker", "session_id", F.lit("exit").alias("kind"), F.col("exit_date").alias("date"))  # one row
    scores = t.scores(spark, sf_dir).select("ticker", "date", "score")
    return open_.unionByName(gone).join(scores, ["ticker", "date"], "left").select("ticker", "session_id", "kind", "date", "score")


@rule("v23_cohort_returns", ("bars",), f"""select s.ticker, session_id, {r('l.close / e.close - 1')} as to_today, {r('f.close / e.close - 1')} as forward_60
from (select *, entry_date + 60 as later from sessions) s join bars e on e.ticker = s.ticker and e.date = s.entry_date join latest l on l.ticker = s.ticker asof left join bars f on f.ticker = s.ticker and f.date >= s.later""", f"{FLAGGED},\n{SESSIONS},\n{RUNS}")
def v23(spark, sf_dir):
    b = t.bars(spark, sf_dir)
    entry = b.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"))
    d = sessions_of(spark, sf_dir).join(entry, ["ticker", "entry_date"]).withColumn("later", F.date_add("entry_date", 60))
    d = j.asof(d, b.select("ticker", "date", F.col("close").alias("forward_close")), "ticker", "later", "date", ["forward_close"], forward=True)
    d = d.join(latest_bars(spark, sf_dir).select("ticker", F.col("close").alias("last_close")), "ticker")
    return d.select("ticker", "session_id", (F.col("last_close") / F.col("entry_close") - 1).alias("to_today"), (F.col("forward_close") / F.col("entry_close") - 1).alias("forward_60"))


@rule("v24_positions_scored", ("fills", "scores"), f"""select p.ticker, {r('net')} as net_quantity, {r('cost / nullif(bought, 0)')} as mean_cost, {r('s.score')} as score
from (select ticker, sum(case when side = 'BUY' then quantity else -quantity end) as net, sum(case when side = 'BUY' then quantity end) as bought, sum(case when side = 'BUY' then quantity * price end) as cost from fills group by ticker) p
left join (select ticker, arg_max(score, date) as score from scores group by ticker) s using (ticker)""")
def v24(spark, sf_dir):
    buy = F.col("side") == "BUY"
    net, bought = F.sum(F.when(buy, F.col("quantity")).otherwise(-F.col("quantity"))), F.sum(F.when(buy, F.col("quantity")))
    cost = F.sum(F.when(buy, F.col("quantity") * F.col("price")))
    p = t.fills(spark, sf_dir).groupBy("ticker").agg(net.alias("net_quantity"), c.safe_ratio(cost, bought).alias("mean_cost"))
    last = t.scores(spark, sf_dir).groupBy("ticker").agg(F.max_by("score", "date").alias("score"))
    return p.join(last, "ticker", "left")


@rule("v25_position_risk", ("bars",), f"""select ticker, date, {r('atr')} as atr_14, {r('vol_20')} as vol_20, {r('vol_60')} as vol_60, {r('support')} as support, {r('resistance')} as resistance, {r('(close - support) / nullif(atr, 0)')} as atrs_above_support
from (select *, avg(tr) {over(14)} as atr, stddev_samp(ret) {over(20)} * sqrt(252) as vol_20, stddev_samp(ret) {over(60)} * sqrt(252) as vol_60, min(low) {over(20)} as support, max(high) {over(20)} as resistance, row_number() over (partition by ticker order by date desc) as n
from (select *, close / lag(close) {LINE} - 1 as ret, greatest(high - low, abs(high - lag(close) {LINE}), abs(low - lag(close) {LINE})) as tr from bars)) where n = 1""")
def v25(spark, sf_dir):
    was = F.lag("close").over(panel())
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was))
    d = t.bars(spark, sf_dir).select("*", (F.col("close") / was - 1).alias("ret"), span.alias("tr"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))).alias("n"))
    d = d.where("n <= 60").groupBy("ticker").agg(  # the last bars alone, counted backwards
        F.max("date").alias("date"), F.max_by("close", "date").alias("close"), F.avg(F.when(F.col("n") <= 14, F.col("tr"))).alias("atr_14"),
        (F.stddev_samp(F.when(F.col("n") <= 20, F.col("ret"))) * 252**0.5).alias("vol_20"), (F.stddev_samp("ret") * 252**0.5).alias("vol_60"),
        F.min(F.when(F.col("n") <= 20, F.col("low"))).alias("support"), F.max(F.when(F.col("n") <= 20, F.col("high"))).alias("resistance"))
    above = c.safe_ratio(F.col("close") - F.col("support"), F.col("atr_14"))
    return d.select("ticker", "date", "atr_14", "vol_20", "vol_60", "support", "resistance", above.alias("atrs_above_support"))


NAV = "navs as (select date, exp(sum(ln(1 + r)) over (order by date)) as nav from daily)"


@rule("v26_nav_drawdown", ("scores",), f"select date, {r('ln(nav)')} as log_nav, {r('nav / greatest(max(nav) over (order by date), 1) - 1')} as drawdown from navs", f"{ENTRIES},\n{EXITS},\n{DAILY},\n{NAV}")
def v26(spark, sf_dir):
    daily = tr.daily_returns(exits_of(spark, sf_dir), t.bars(spark, sf_dir), 10)  # a row a day
    so_far = day_line().rowsBetween(Window.unboundedPreceding, 0)
    d = daily.select("date", F.exp(F.sum(F.log1p("r")).over(so_far)).alias("nav"))
    return d.select("date", F.log("nav").alias("log_nav"), (F.col("nav") / F.greatest(F.max("nav").over(so_far), F.lit(1.0)) - 1).alias("drawdown"))


SEEN = "over (order by date rows between 1259 preceding and current row)"


@rule("v28_pillar_percentiles", ("macro",), f"select date, {r('trend')} as trend, {r('risk')} as risk, case when len(seen) >= 252 then {r('len(list_filter(seen, lambda v: v <= trend)) * 1.0 / len(seen)')} end as trend_percentile from (select *, list(trend) filter (where trend is not null) {SEEN} as seen from pillars)", f"{WIDE},\n{PILLARS}")
def v28(spark, sf_dir):
    d = pillars(spark, sf_dir).withColumn("seen", F.collect_list("trend").over(day_line().rowsBetween(-1259, 0)))  # a row a day
    share = F.size(F.filter("seen", lambda v: v <= F.col("trend"))) / F.size("seen")
    return d.select("date", "trend", "risk", F.when(F.size("seen") >= 252, share).alias("trend_percentile"))
