"""Sessions (G), labels (L), trade paths (B) and layered views (V)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import panel
from barsmith.operators import joins as j
from barsmith.operators import sessions as s
from barsmith.operators import trades as b
from barsmith.plans.base import LINE, SO_FAR, following, query, with_views
from barsmith.plans.features import FLAGGED, flagged, rounded, rounded_sql
from barsmith.sources import tables as t

GRACE = 5
HOLD_SQL = "coalesce(close > s5 and close > s15, false)"
SESSIONS = f"""marked as (select *, {HOLD_SQL} as h, lead(date) {LINE} as next_date from flagged),
runs as (select *, sum(cast(h and not was as int)) {SO_FAR} as run from (select *, coalesce(lag(h) {LINE}, false) as was from marked)),
sessions as (select ticker, row_number() over (partition by ticker order by entry_date) as session_id, entry_date, exit_date, last_hold from (
  select ticker, run, min(date) filter (where breakout_ok) as entry_date, max(date) as last_hold, arg_max(next_date, date) as raw_exit, max(date) as d from runs where h group by 1, 2) x
  join (select ticker as tk, date as dd, next_date as exit_date from marked) m on m.tk = x.ticker and m.dd = x.d where entry_date is not null)"""


def hold():
    return (F.col("close") > F.col("s5")) & (F.col("close") > F.col("s15"))


def sessions_of(spark, sf_dir, closes=False):
    return s.trade_sessions(flagged(spark, sf_dir), hold(), F.col("breakout_ok"), closes)


@query("g1_membership_log", with_views("bars", more=f"""d as (select ticker, date, cast(close >= 500 as int) as ok from bars),
i as (select *, sum(ok) {SO_FAR} as island from d),
f as (select *, sum(1 - ok) over (partition by ticker, island order by date rows between unbounded preceding and current row) as streak from i),
e as (select ticker, date, ok = 1 as is_active from f where ok = 1 or (island > 0 and streak = {GRACE}))""",
    sql=f"select ticker, date as effective_date, is_active from (select *, lag(is_active) {LINE} as p from e) where (p is null and is_active) or p <> is_active"))
def g1(spark, sf_dir):
    return s.membership_log(t.bars(spark, sf_dir), F.col("close") >= 500, GRACE)


@query("g3_active_on", with_views("bars", more=f"""log as (select ticker, date as effective_date, close > open as is_active from bars)""", sql="select ticker from log where effective_date <= date '1999-06-30' group by ticker having arg_max(is_active, effective_date)"))
def g3(spark, sf_dir):
    log = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("effective_date"), (F.col("close") > F.col("open")).alias("is_active"))
    return s.active_on(log, F.lit("1999-06-30").cast("date"))


@query("g2_membership_delta", with_views("bars", sql="""select d.ticker, d.date as effective_date, d.a as is_active from (select ticker, date, close > open as a from bars where date = date '1999-07-01') d
left join (select ticker, arg_max(close > open, date) as was from bars where date < date '1999-07-01' group by ticker) s using (ticker) where coalesce(was, false) <> d.a"""))
def g2(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date", (F.col("close") > F.col("open")).alias("is_active"))
    return s.membership_delta(d.where("date < '1999-07-01'").withColumnRenamed("date", "effective_date"), d.where("date = '1999-07-01'"))


@query("g5_g6_trade_sessions", with_views("bars", more=f"{FLAGGED},\n{SESSIONS}", sql="select * from sessions"))
def g5(spark, sf_dir):
    return sessions_of(spark, sf_dir)


@query("g13_retriggers", with_views("bars", more=f"{FLAGGED},\n{SESSIONS}", sql="select ticker, session_id, coalesce(date_diff('day', lag(exit_date) over (partition by ticker order by entry_date), entry_date) <= 14, false) as retrigger from sessions"))
def g13(spark, sf_dir):
    return s.retriggers(sessions_of(spark, sf_dir)).select("ticker", "session_id", "retrigger")


@query("g9_current_runs", with_views("bars", more=FLAGGED, sql=f"""select ticker, min(date) as start_date, arg_min(close, date) as start_close, count(*) as length from (
select *, sum(cast(not t as int)) {SO_FAR} as island, max(date) over (partition by ticker) as last from (select *, {HOLD_SQL} as t from flagged)) where t group by ticker, island, last having max(date) = last"""))
def g9(spark, sf_dir):
    return s.current_runs(flagged(spark, sf_dir), hold())


@query("g10_drought", with_views("bars", more=FLAGGED, sql="select date_diff('day', max(date) filter (where n > 0), max(date)) as drought_days from (select date, count(*) filter (where breakout_ok) as n from flagged group by date)"))
def g10(spark, sf_dir):
    return s.drought(flagged(spark, sf_dir).groupBy("date").agg(F.count_if("breakout_ok").alias("n")))


OUTCOMES = f"""select ticker, session_id, entry_date, exit_date, {rounded_sql('last_close / entry_close - 1')} as return_pct, {rounded_sql('top / entry_close - 1')} as mfe, {rounded_sql('bottom / entry_close - 1')} as mae, mfe_date, mae_date,
  date_diff('day', entry_date, last_date) as holding_days, days_observed from (
select s.ticker, session_id, entry_date, exit_date, arg_min(close, date) as entry_close, arg_max(close, date) as last_close, max(high) as top, min(low) filter (where date > entry_date) as bottom, arg_min(date, (-high, date)) as mfe_date,
  arg_min(date, (low, date)) filter (where date > entry_date) as mae_date, max(date) as last_date, count(*) as days_observed
from sessions s join bars b on b.ticker = s.ticker and b.date >= entry_date and (exit_date is null or b.date <= exit_date) group by 1, 2, 3, 4)"""


@query("a9_v8_trade_outcomes", with_views("bars", more=f"{FLAGGED},\n{SESSIONS}", sql=OUTCOMES))
def a9(spark, sf_dir):
    d = s.outcomes(sessions_of(spark, sf_dir), t.bars(spark, sf_dir))
    return d.select("ticker", "session_id", "entry_date", "exit_date", *[rounded(F.col(n)).alias(n) for n in ("return_pct", "mfe", "mae")], "mfe_date", "mae_date", "holding_days", "days_observed")


@query("j14_v7_hydrated_trades", with_views("bars", more=f"{FLAGGED},\n{SESSIONS}", sql="select s.ticker, session_id, b.date, row_number() over (partition by s.ticker, session_id order by b.date) as day_in_trade, b.close from sessions s join bars b on b.ticker = s.ticker and b.date >= entry_date and (exit_date is null or b.date <= exit_date)"))
def j14(spark, sf_dir):
    d = j.interval_join(t.bars(spark, sf_dir), sessions_of(spark, sf_dir), "ticker", "date", "entry_date", "exit_date", closed=True)
    return d.select("ticker", "session_id", "date", F.row_number().over(Window.partitionBy("ticker", "session_id").orderBy("date")).alias("day_in_trade"), "close")


@query("v6_features_with_fundamentals", with_views("bars", "fundamentals", "shares", more=f"{FLAGGED}", sql=f"""
select b.ticker, b.date, date_diff('day', f.filing_date, b.date) as days_since_report, {rounded_sql('b.close * sh.shares_outstanding / nullif(f.revenue, 0)')} as ps
from (select * from flagged where breakout_ok) b asof left join (select * from fundamentals qualify row_number() over (partition by ticker, filing_date order by period_end desc) = 1) f on b.ticker = f.ticker and b.date >= f.filing_date
asof left join shares sh on b.ticker = sh.ticker and b.date >= sh.date"""))
def v6(spark, sf_dir):
    d = flagged(spark, sf_dir).where("breakout_ok").select("ticker", "date", "close")
    f = j.latest_per_key(t.fundamentals(spark, sf_dir), ["ticker", "filing_date"], [F.desc("period_end")])
    d = j.asof(d, f, "ticker", "date", "filing_date", ["filing_date", "revenue"])
    d = j.asof(d, t.shares(spark, sf_dir).withColumnRenamed("date", "as_of"), "ticker", "date", "as_of", ["shares_outstanding"])
    return d.select("ticker", "date", F.date_diff("date", "filing_date").alias("days_since_report"), rounded(c.safe_ratio(F.col("close") * F.col("shares_outstanding"), "revenue")).alias("ps"))


H = 20


@query("l1_l3_dense_labels", with_views("bars", sql=f"select ticker, date, {rounded_sql('hi / close - 1')} as mfe, {rounded_sql('lo / close - 1')} as mae, {rounded_sql('ahead / close - 1')} as fwd, cast(n = {H} as int) as full_window from (select *, max(greatest(high, close)) {following(H)} as hi, min(least(low, close)) {following(H)} as lo, lead(close, {H}) {LINE} as ahead, count(*) {following(H)} as n from bars) where n > 0"))
def l1(spark, sf_dir):
    f = c.ahead(H)
    d = t.bars(spark, sf_dir).withColumns({"hi": F.max(F.greatest("high", "close")).over(f), "lo": F.min(F.least("low", "close")).over(f), "ahead": F.lead("close", H).over(panel()), "n": F.count("close").over(f)}).where("n > 0")
    ratio = lambda x: rounded(F.col(x) / F.col("close") - 1)
    return d.select("ticker", "date", ratio("hi").alias("mfe"), ratio("lo").alias("mae"), ratio("ahead").alias("fwd"), (F.col("n") == H).cast("int").alias("full_window"))


@query("l2_tail_label", with_views("bars", sql=f"select ticker, date, {rounded_sql('greatest(hi / close - 1 - 0.3, 0)')} as tail, cast(hi / close - 1 > 0.3 as int) as flag from (select *, max(high) {following(H)} as hi, count(*) {following(H)} as n from bars) where n = {H}"))
def l2(spark, sf_dir):
    d = t.bars(spark, sf_dir).withColumns({"hi": F.max("high").over(c.ahead(H)), "n": F.count("close").over(c.ahead(H))}).where(F.col("n") == H)
    gain = F.col("hi") / F.col("close") - 1
    return d.select("ticker", "date", rounded(F.greatest(gain - 0.3, F.lit(0.0))).alias("tail"), (gain > 0.3).cast("int").alias("flag"))


@query("l4_breakout_proximity", with_views("bars", more=FLAGGED, sql=f"select f.ticker, f.date, {rounded_sql('coalesce(exp(-0.05 * date_diff(chr(100) || chr(97) || chr(121), f.date, min(e.date))), 0)')} as proximity from flagged f left join flagged e on e.ticker = f.ticker and e.breakout_ok and e.date > f.date and e.date <= f.date + 60 group by 1, 2".replace("chr(100) || chr(97) || chr(121)", "'day'")))
def l4(spark, sf_dir):
    f = flagged(spark, sf_dir)
    d = j.next_event(f.select("ticker", "date"), f.where("breakout_ok").select("ticker", F.col("date").alias("event")), "ticker", "date", "event", 60)
    return d.select("ticker", "date", rounded(F.coalesce(F.when(F.col("next_date").isNotNull(), F.exp(-0.05 * F.col("days_to_event"))), F.lit(0.0))).alias("proximity"))


@query("l5_outcome_classes", with_views("bars", more=f"{FLAGGED},\n{SESSIONS}", sql=f"select ticker, session_id, case when mfe <= 0.1 then 0 when mfe <= 0.3 then 1 when mfe <= 1.0 then 2 else 3 end as cls from ({OUTCOMES})"))
def l5(spark, sf_dir):
    return s.outcomes(sessions_of(spark, sf_dir), t.bars(spark, sf_dir)).select("ticker", "session_id", c.bin_class(rounded(F.col("mfe")), (0.1, 0.3, 1.0)).alias("cls"))


@query("l6_forward_returns", with_views("bars", sql="select ticker, date, " + ", ".join(f"{rounded_sql(f'lead(close, {h}) {LINE} / close - 1')} as r{h}" for h in (1, 5, 20)) + " from bars"))
def l6(spark, sf_dir):
    return t.bars(spark, sf_dir).select("ticker", "date", *[rounded(F.lead("close", h).over(panel()) / F.col("close") - 1).alias(f"r{h}") for h in (1, 5, 20)])


@query("l8_label_audit", with_views("bars", sql=f"""select a.ticker, a.date, {rounded_sql('max(b.high) / a.close - 1')} as mfe from bars a join bars b on a.ticker = b.ticker and b.date > a.date and b.date <= a.date + 30 group by a.ticker, a.date, a.close"""))
def l8(spark, sf_dir):
    ahead = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(1, 30)
    d = t.bars(spark, sf_dir).withColumn("h", F.max("high").over(ahead)).where("h is not null")
    return d.select("ticker", "date", rounded(F.col("h") / F.col("close") - 1).alias("mfe"))


ENTRIES = """entries as (select ticker, date as entry_date, score from (select * from scores where score >= 0.95 qualify row_number() over (partition by date order by score desc, ticker) <= 2) qualify row_number() over (partition by ticker order by date) = 1)"""
EXITS = f"""held as (select e.ticker, entry_date, b.date, open, low, b.close, first(b.close) over w as entry_price, max(b.close) over (partition by e.ticker, entry_date order by b.date rows between unbounded preceding and 1 preceding) as peak
  from entries e join bars b on b.ticker = e.ticker and b.date >= entry_date and b.date <= entry_date + 90 window w as (partition by e.ticker, entry_date order by b.date)),
why as (select *, case when date > entry_date and low <= entry_price * (1 - 0.5) then 'stop' when date > entry_date and low <= peak * (1 - 0.6) then 'trail' end as reason from held),
exits as (select ticker, entry_date, entry_price, case when min(date) filter (where reason is not null) is null then max(date) else min(date) filter (where reason is not null) end as exit_date from why group by 1, 2, 3)"""


@query("b1_select_entries", with_views("scores", more=ENTRIES, sql="select ticker, entry_date, round(score, 6) as score from entries"))
def b1(spark, sf_dir):
    return b.select_entries(t.scores(spark, sf_dir), 0.95, 2).withColumn("score", F.round("score", 6))


def exits_of(spark, sf_dir):
    return b.label_exits(b.select_entries(t.scores(spark, sf_dir), 0.95, 2), t.bars(spark, sf_dir), 0.5, 0.6, 90)


@query("b2_exit_labels", with_views("scores", more=f"{ENTRIES},\n{EXITS}", sql=f"""select x.ticker, x.entry_date, {rounded_sql('x.entry_price')} as entry_price, exit_date, coalesce(reason, 'timeout') as reason,
{rounded_sql("case reason when 'stop' then least(open, w.entry_price * (1 - 0.5)) when 'trail' then least(open, peak * (1 - 0.6)) else close end")} as exit_price from exits x join why w on w.ticker = x.ticker and w.entry_date = x.entry_date and w.date = x.exit_date"""))
def b2(spark, sf_dir):
    return exits_of(spark, sf_dir).select("ticker", "entry_date", rounded(F.col("entry_price")).alias("entry_price"), "exit_date", "reason", rounded(F.col("exit_price")).alias("exit_price"))


@query("b3_capacity_slots")
def b3(spark, sf_dir):
    x = exits_of(spark, sf_dir).select((F.crc32(F.col("ticker").cast("binary")) % 4).cast("int").alias("book_id"), "ticker", "entry_date", "exit_date")
    return b.admit(x, 3)


@query("b4_costs", with_views("fills", sql=f"select ticker, {rounded_sql('sum(case when side = $$BUY$$ then -quantity * price else quantity * price end - fees)')} as net from fills group by ticker".replace("$$BUY$$", "'BUY'")))
def b4(spark, sf_dir):
    cash = F.when(F.col("side") == "BUY", -F.col("quantity") * F.col("price")).otherwise(F.col("quantity") * F.col("price")) - F.col("fees")
    return t.fills(spark, sf_dir).groupBy("ticker").agg(rounded(F.sum(cash)).alias("net"))


DAILY = f"""daily as (select b.date, sum(r) / 10 as r from exits x join (select ticker, date, close / lag(close) {LINE} - 1 as r from bars) b on b.ticker = x.ticker and b.date > x.entry_date and b.date <= x.exit_date group by 1)"""


@query("b5_daily_equity", with_views("scores", more=f"{ENTRIES},\n{EXITS},\n{DAILY}", sql=f"select date, {rounded_sql('r')} as r from daily"))
def b5(spark, sf_dir):
    return b.daily_returns(exits_of(spark, sf_dir), t.bars(spark, sf_dir), 10).select("date", rounded(F.col("r")).alias("r"))


@query("b6_book_metrics", with_views("scores", more=f"{ENTRIES},\n{EXITS},\n{DAILY}", sql=f"select {rounded_sql('avg(r) / nullif(stddev_samp(r), 0) * sqrt(252)')} as sharpe, {rounded_sql('avg(r) * 252')} as year_return, {rounded_sql('stddev_samp(r) * sqrt(252)')} as year_vol, count(*) as days from daily"))
def b6(spark, sf_dir):
    m = b.book_metrics(b.daily_returns(exits_of(spark, sf_dir), t.bars(spark, sf_dir), 10))
    return m.select(*[rounded(F.col(n)).alias(n) for n in ("sharpe", "year_return", "year_vol")], "days")
