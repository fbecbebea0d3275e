"""Trade books (B) in full: gated entries, exits that depend on the path, shared-pool equity and its metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.operators import books as k
from barsmith.operators import trades as b
from barsmith.operators.writes import reread
from barsmith.plans.base import query, with_views
from barsmith.plans.features import rounded, rounded_sql
from barsmith.sources import tables as t

RULES = k.Rules(stop=0.5, sma=20, nday=10, atr=14, atr_multiple=1.5, breakeven_at=0.3, trail=0.4, most_bars=60, add_at=0.25)
LEAST, PER_DAY, WARMUP, SIZE, STARTER, COST = 0.9, 3, 10, 0.1, 0.5, 0.004
CALM = 20


def exposure_of(spark, sf_dir):
    """date, weight of the benchmark of the day before: 0 under 95 % of its average, 0.5 under the average, else 1."""
    line = Window.orderBy("date")
    d = t.benchmark_series(spark, sf_dir).withColumn("m", F.round(F.avg("spy_close").over(line.rowsBetween(1 - CALM, 0)), 6))
    weight = F.when(F.col("spy_close") < F.round(0.95 * F.col("m"), 6), 0.0).when(F.col("spy_close") < F.col("m"), 0.5).otherwise(1.0)
    return d.select("date", F.lag(weight).over(line).alias("weight")).where("weight is not null")


EXPOSURE = f"""exposure as (select * from (select date, lag(case when spy_close < round(0.95 * m, 6) then 0.0 when spy_close < m then 0.5 else 1.0 end) over (order by date) as weight
  from (select *, round(avg(spy_close) over (order by date rows between {CALM - 1} preceding and current row), 6) as m from bench)) where weight is not null)"""
ENTRIES = f"""eligible as (select * from scores where score >= {LEAST}),
entries as (select ticker, min(date) as entry_date, arg_min(score, date) as score from (
  select ticker, date, score, row_number() over (partition by date order by score desc, ticker) as best from eligible
  where date >= (select date from (select distinct date from eligible) order by date limit 1 offset {WARMUP}) and date not in (select date from exposure where weight <= 0)) where best <= {PER_DAY} group by ticker)"""
EXITS = f"""priced as (select *, avg(close) over (partition by ticker order by date rows between {RULES.sma - 1} preceding and current row) as sma, avg(tr) over (partition by ticker order by date rows between {RULES.atr - 1} preceding and current row) as atr
  from (select *, row_number() over w as n, case when lag(close) over w is null then high - low else greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr from bars window w as (partition by ticker order by date))),
opened as (select e.*, p.close as entry_price, p.n as n0 from entries e join priced p on p.ticker = e.ticker and p.date = e.entry_date),
held as (select o.ticker, entry_date, score, entry_price, p.date, open, high, low, close, sma, atr, p.n - n0 as bars_held, max(high) over so_far as run_high,
    max(high - {RULES.atr_multiple} * atr) over (partition by o.ticker, entry_date order by p.n rows between unbounded preceding and 1 preceding) as raised
  from opened o join priced p on p.ticker = o.ticker and p.n > n0 and p.n <= n0 + {RULES.most_bars} window so_far as (partition by o.ticker, entry_date order by p.n rows between unbounded preceding and current row)),
levels as (select *, entry_price * {1 - RULES.stop} as initial from held),
ways as (
  select 'sma' as policy, *, initial as level, 'stop_loss' as why, close < sma as second, 'trend_break' as other from levels
  union all select 'nday', *, initial, 'stop_loss', bars_held >= {RULES.nday}, 'nday_exit' from levels
  union all select 'atr_trail', *, run_high - {RULES.atr_multiple} * atr, 'stop_loss', false, '' from levels
  union all select 'breakeven', *, case when run_high >= entry_price * {1 + RULES.breakeven_at} then greatest(entry_price, run_high * {1 - RULES.trail}) else initial end, 'stop_loss', false, '' from levels
  union all select 'ratchet', *, greatest(initial, coalesce(raised, initial)), case when raised > initial then 'trail_stop' else 'stop_loss' end, false, '' from levels),
first_exit as (select policy, ticker, entry_date, min(date) as exit_date, arg_min(reason, date) as reason, arg_min(fill, date) as exit_price from (
  select *, case when low <= level then why when second then other when bars_held >= {RULES.most_bars} then 'max_hold' end as reason, case when low <= level then least(level, open) else close end as fill from ways)
  where reason is not null group by 1, 2, 3),
adds as (select ticker, entry_date, min(date) as add_date from held where high >= entry_price * {1 + RULES.add_at} group by 1, 2),
ends as (select ticker, max(date) as last_date, arg_max(close, date) as last_close from bars group by 1),
trades as (select p.policy, o.ticker, o.entry_date, o.score, o.entry_price, coalesce(x.exit_date, last_date) as exit_date, coalesce(x.exit_price, last_close) as exit_price, coalesce(x.reason, 'held_open') as reason, add_date
  from opened o cross join (values ('sma'), ('nday'), ('atr_trail'), ('breakeven'), ('ratchet')) p(policy) join ends using (ticker) left join adds a on a.ticker = o.ticker and a.entry_date = o.entry_date
  left join first_exit x on x.policy = p.policy and x.ticker = o.ticker and x.entry_date = o.entry_date)"""
BOOK = f"{EXPOSURE},\n{ENTRIES},\n{EXITS}"


def entries_of(spark, sf_dir):
    return k.gated_entries(t.scores(spark, sf_dir).select("ticker", "date", "score"), LEAST, PER_DAY, WARMUP, exposure_of(spark, sf_dir))


def entered(spark, sf_dir):
    """The entries, and the bars of their tickers: at most PER_DAY of a day, so they are sent to all tasks. Written once, as exits and
    curves read them again and again."""
    entries = reread(entries_of(spark, sf_dir), "entries")
    some = t.bars(spark, sf_dir).join(F.broadcast(entries.select("ticker").distinct()), "ticker", "left_semi")
    return entries, reread(some, "entered-bars")


def trades_of(spark, sf_dir, *policies):
    return k.path_exits(*entered(spark, sf_dir), RULES, policies or k.POLICIES)


@query("b1_gated_entries", with_views("scores", "bench", more=f"{EXPOSURE},\n{ENTRIES}", sql="select ticker, entry_date, round(score, 6) as score from entries"))
def b1(spark, sf_dir):
    return entries_of(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("b2_exit_policies", with_views("scores", "bench", more=BOOK, sql=f"""select policy, ticker, entry_date, {rounded_sql('entry_price')} as entry_price, exit_date, {rounded_sql('exit_price')} as exit_price, reason,
{rounded_sql('exit_price / entry_price - 1')} as pnl_pct, date_diff('day', entry_date, exit_date) as holding_days, add_date from trades"""))
def b2(spark, sf_dir):
    d = trades_of(spark, sf_dir)
    return d.select("policy", "ticker", "entry_date", rounded(F.col("entry_price")).alias("entry_price"), "exit_date", rounded(F.col("exit_price")).alias("exit_price"), "reason", rounded(F.col("pnl_pct")).alias("pnl_pct"), "holding_days", "add_date")


@query("b3_capacity_by_score", with_views("scores", "bench", more=f"""{BOOK},
queue as (select policy, ticker, entry_date, exit_date, row_number() over (partition by policy order by entry_date, score desc, ticker) as i from trades),
walk as (select policy, cast(0 as bigint) as i, cast([] as date[]) as busy, false as admitted from queue where i = 1
  union all select q.policy, q.i, case when len(list_filter(busy, lambda x: x > q.entry_date)) < 4 then list_append(list_filter(busy, lambda x: x > q.entry_date), q.exit_date) else list_filter(busy, lambda x: x > q.entry_date) end,
    len(list_filter(busy, lambda x: x > q.entry_date)) < 4 from walk w join queue q on q.policy = w.policy and q.i = w.i + 1)""", sql="select policy, ticker, entry_date, exit_date, admitted from walk join queue using (policy, i)"))
def b3(spark, sf_dir):
    d = trades_of(spark, sf_dir).select(F.col("policy").alias("book_id"), "ticker", "entry_date", "exit_date", "score")
    return b.admit(d, 4, "score").select(F.col("book_id").alias("policy"), "ticker", "entry_date", "exit_date", "admitted")


POLICY = "breakeven"
CURVE = f"""span as (select min(entry_date) as lo, max(exit_date) as hi from trades where policy = '{POLICY}'),
grid as (select cast(d as date) as date from (select unnest(generate_series(lo, hi, interval 1 day)) as d from span) where isodow(d) <= 5),
spans as (select ticker, cast(entry_date + case isodow(entry_date) when 6 then 2 when 7 then 1 else 0 end as date) as begins, cast(exit_date + case isodow(exit_date) when 6 then 2 when 7 then 1 else 0 end as date) as ends_at,
  cast(add_date + case isodow(add_date) when 6 then 2 when 7 then 1 else 0 end as date) as adds_at from trades where policy = '{POLICY}'),
live as (select s.* from spans s, span where ends_at <= hi and begins < ends_at),
rets as (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as r from bars, span where isodow(date) <= 5 and date between lo and hi),
earned as (select date, sum(r * case when adds_at is not null and date >= adds_at then 1.0 else {STARTER} end) as earned from live l join rets using (ticker) where date > begins and date <= ends_at and r is not null group by date),
counts as (select g.date, count(l.ticker) as open_trades from grid g left join live l on l.begins <= g.date and g.date < l.ends_at group by g.date),
curve as (select *, product(1 + daily_return) over (order by date) as growth from (
  select c.date, open_trades, coalesce(earned, 0) * {SIZE} * case when open_trades > {round(1 / SIZE)} then {round(1 / SIZE)}.0 / open_trades else 1.0 end
    * coalesce((select arg_max(weight, x.date) from exposure x join grid y on y.date = x.date where x.date <= c.date), 1.0) as daily_return from counts c left join earned e on e.date = c.date))"""


def curve_of(spark, sf_dir):
    """The trades of POLICY, written once, and their curve."""
    entries, some = entered(spark, sf_dir)
    trades = reread(k.path_exits(entries, some, RULES, (POLICY,)), "trades")
    return trades, k.equity_curve(trades, some, SIZE, STARTER, exposure_of(spark, sf_dir))


@query("b5_equity_curve", with_views("scores", "bench", more=f"{BOOK},\n{CURVE}", sql=f"select date, open_trades, {rounded_sql('daily_return')} as daily_return, {rounded_sql('growth')} as growth from curve"))
def b5(spark, sf_dir):
    return curve_of(spark, sf_dir)[1].select("date", "open_trades", rounded(F.col("daily_return")).alias("daily_return"), rounded(F.col("growth")).alias("growth"))


METRICS = ("sharpe", "ann_return", "ann_vol", "total_return", "max_drawdown", "calmar")


@query("b6_equity_metrics", with_views("scores", "bench", more=f"""{BOOK},\n{CURVE},
steps as (select *, growth / lag(growth) over (order by date) - 1 as r, growth / max(growth) over (order by date) - 1 as down from curve),
m as (select avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) as sharpe, pow(arg_max(growth, date) / arg_min(growth, date), 252.0 / count(*)) - 1 as ann_return, stddev_samp(r) * sqrt(252) as ann_vol,
  arg_max(growth, date) / arg_min(growth, date) - 1 as total_return, min(down) as max_drawdown, count(*) as days from steps),
w as (select count(*) as n_trades, avg(cast(exit_price / entry_price - 1 - {COST} > 0 as int)) as win_rate, avg(exit_price / entry_price - 1 - {COST}) as avg_pnl from trades where policy = '{POLICY}')""",
    sql=f"select {', '.join(f'{rounded_sql(x)} as {x}' for x in METRICS[:5])}, {rounded_sql('ann_return / nullif(-max_drawdown, 0)')} as calmar, days, n_trades, {rounded_sql('win_rate')} as win_rate, {rounded_sql('avg_pnl')} as avg_pnl from m, w"))
def b6(spark, sf_dir):
    trades, curve = curve_of(spark, sf_dir)
    both = k.curve_metrics(curve).crossJoin(k.trade_metrics(trades, COST))  # one row each
    return both.select(*[rounded(F.col(x)).alias(x) for x in METRICS], "days", "n_trades", rounded(F.col("win_rate")).alias("win_rate"), rounded(F.col("avg_pnl")).alias("avg_pnl"))
