"""Risk bands with a veto (M10 to M12), stress over four series (M14) and periods as days (M22) in full, with their SQL.

Windows without a key run over one row a day of the macro table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.operators import regimes as rg
from barsmith.plans.base import query, with_views
from barsmith.plans.features import rounded, rounded_sql
from barsmith.plans.markets import PILLARS, WIDE, filled, pillars
from barsmith.sources import tables as t

Z, PCT, VETO = 120, 250, 2.0
WEIGHTS = {"a": 0.5, "b": 0.3, "x": 0.2}
BANDS = ((0.4, 1.0), (0.7, 0.6), (0.9, 0.3))
LINE = "order by date rows between {n} preceding and current row"
Z_SQL = ", ".join(f"case when count({n}) over w = {Z} then ({n} - avg({n}) over w) / nullif(stddev_samp({n}) over w, 0) end as z{n}" for n in WEIGHTS)
SCORED = f"""{WIDE},
zs as (select date, {Z_SQL} from filled window w as ({LINE.format(n=Z - 1)})),
wz as (select *, round({' + '.join(f'{w} * z{n}' for n, w in WEIGHTS.items())}, 9) as wz, coalesce(greatest(za, zb, zx) >= {VETO}, false) as veto from zs),
pc as (select *, case when len(seen) = {PCT} then len(list_filter(seen, lambda v: v < wz)) / {PCT - 1} end as pct from (select *, list(wz) over ({LINE.format(n=PCT - 1)}) as seen from wz where wz is not null)),
bd as (select *, case when pct is null then null when pct < 0.4 then 1.0 when pct < 0.7 then 0.6 when pct < 0.9 then 0.3 else 0.0 end as base from pc)"""


@query("m12_risk_bands", with_views("macro", more=SCORED, sql=f"select date, {rounded_sql('wz')} as weighted_z, veto, {rounded_sql('pct')} as percentile, cast(base as double) as base_exposure, cast(case when veto and base is not null then 0.0 else base end as double) as target_exposure from bd"))
def m12(spark, sf_dir):
    days = Window.orderBy("date")
    w = days.rowsBetween(1 - Z, 0)
    z = lambda n: F.when(F.count(n).over(w) == Z, (F.col(n) - F.avg(n).over(w)) / F.nullif(F.stddev_samp(n).over(w), F.lit(0.0))).alias(f"z{n}")
    d = filled(spark, sf_dir).select("date", *map(z, WEIGHTS))
    total = sum((weight * F.col(f"z{n}") for n, weight in WEIGHTS.items()), F.lit(0.0))
    d = d.withColumns({"wz": F.round(total, 9), "veto": F.coalesce(F.greatest(*[f"z{n}" for n in WEIGHTS]) >= VETO, F.lit(False))}).where("wz is not null")
    d = d.withColumn("seen", F.collect_list("wz").over(days.rowsBetween(1 - PCT, 0))).withColumn("pct", c.rolling_percentile("seen", "wz", PCT))
    base = F.lit(0.0)
    for top, exposure in reversed(BANDS):
        base = F.when(F.col("pct") < top, exposure).otherwise(base)
    d = d.withColumn("base", F.when(F.col("pct").isNotNull(), base))
    return d.select("date", rounded(F.col("wz")).alias("weighted_z"), "veto", rounded(F.col("pct")).alias("percentile"), F.col("base").alias("base_exposure"), F.when(F.col("veto") & F.col("base").isNotNull(), 0.0).otherwise(F.col("base")).alias("target_exposure"))


SIGNS = {"a": 1, "b": -1, "x": -1, "gap": 1}
LEAST = 60
EXPANDING = ", ".join(f"case when count({n}) over f >= {LEAST} then {s} * ({n} - avg({n}) over f) / nullif(stddev_samp({n}) over f, 0) end as z{n}" for n, s in SIGNS.items())


@query("m14_stress_composite", with_views("macro", more=WIDE, sql=f"""select date, n_series, {rounded_sql('total / nullif(n_series, 0)')} as stress from (
select date, coalesce(za, 0) + coalesce(zb, 0) + coalesce(zx, 0) + coalesce(zgap, 0) as total, cast(za is not null as int) + cast(zb is not null as int) + cast(zx is not null as int) + cast(zgap is not null as int) as n_series
from (select date, {EXPANDING} from (select *, a - b as gap from filled) window f as (order by date rows between unbounded preceding and 1 preceding)))"""))
def m14(spark, sf_dir):
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    z = lambda n, s: F.when(F.count(n).over(before) >= LEAST, s * (F.col(n) - F.avg(n).over(before)) / F.nullif(F.stddev_samp(n).over(before), F.lit(0.0))).alias(f"z{n}")
    d = filled(spark, sf_dir).withColumn("gap", F.col("a") - F.col("b")).select("date", *[z(n, s) for n, s in SIGNS.items()])
    there = F.filter(F.array(*[f"z{n}" for n in SIGNS]), lambda v: v.isNotNull())
    d = d.select("date", F.size(there).alias("n_series"), F.aggregate(there, F.lit(0.0), lambda s, v: s + v).alias("total"))
    return d.select("date", "n_series", rounded(F.when(F.col("n_series") > 0, F.col("total") / F.col("n_series"))).alias("stress"))


@query("m22_days_keep_last", with_views("fundamentals", sql="""select ticker, day, arg_max(period_end, period_end) as period_end, arg_max(case when net_income > 0 then 'BULL' else 'BEAR' end, period_end) as regime
from (select ticker, period_end, net_income, cast(unnest(generate_series(cast(period_end as timestamp), cast(period_end + 120 as timestamp), interval 1 day)) as date) as day from fundamentals) group by ticker, day"""))
def m22(spark, sf_dir):
    """Periods of 120 days overlap by a month; of the periods of a day the last one counts."""
    regime = F.when(F.col("net_income") > 0, "BULL").otherwise("BEAR")
    days = t.fundamentals(spark, sf_dir).select("ticker", "period_end", regime.alias("regime"), F.explode(F.sequence("period_end", F.date_add("period_end", 120))).alias("day"))
    return days.groupBy("ticker", "day").agg(F.max(F.struct("period_end", "regime")).alias("x")).select("ticker", "day", F.col("x.period_end").alias("period_end"), F.col("x.regime").alias("regime"))


# A day's true regime: the benchmark more than 2 % above or below its mean of 200 days. The trend pillar is the score.
TRUTH = f"""{WIDE},
{PILLARS},
truth as (select date, case when spy_close > 1.02e0 * m then 'BULL' when spy_close < 0.98e0 * m then 'BEAR' else 'FLAT' end as regime from (select *, avg(spy_close) over (order by date rows between 199 preceding and current row) as m from bench)),
days as (select date, regime, {rounded_sql('trend')} as score from truth join pillars using (date) where trend is not null),
runs as (select *, sum(turn) over (order by date) as run from (select *, cast(regime is distinct from lag(regime) over (order by date) as int) as turn from days)),
lags as (select *, first_signal is not null as detected, date_diff('day', start_date, coalesce(first_signal, end_date)) as lag_days
  from (select min(date) as start_date, max(date) as end_date, min(date) filter (where score < {rg.SIGNAL}) as first_signal from runs where regime = 'BEAR' group by run))"""
VIEWS = ("macro", "bars", "bench")


def days_of(spark, sf_dir):
    mean = F.avg("spy_close").over(Window.orderBy("date").rowsBetween(-199, 0))
    regime = F.when(F.col("spy_close") > 1.02 * mean, "BULL").when(F.col("spy_close") < 0.98 * mean, "BEAR").otherwise("FLAT")
    truth = t.benchmark_series(spark, sf_dir).select("date", regime.alias("regime"))
    return truth.join(pillars(spark, sf_dir), "date").where("trend is not null").select("date", "regime", rounded(F.col("trend")).alias("score"))


@query("m20_reaction_lags", with_views(*VIEWS, more=TRUTH, sql="select start_date, end_date, first_signal, detected, lag_days from lags"))
def m20_lags(spark, sf_dir):
    return rg.reaction_lags(days_of(spark, sf_dir))


@query("m20_score_by_regime", with_views(*VIEWS, more=TRUTH, sql=f"""select regime, n_days, {', '.join(f'{rounded_sql(x)} as {n}' for n, x in (("mean", "a"), ("std", "s"), ("min", "lo"), ("max", "hi"), ("share", "n_days / sum(n_days) over ()")))}
from (select regime, count(*) as n_days, avg(score) as a, stddev_samp(score) as s, min(score) as lo, max(score) as hi from days group by regime)"""))
def m20_scores(spark, sf_dir):
    d = rg.score_by_regime(days_of(spark, sf_dir))
    return d.select("regime", "n_days", *[rounded(F.col(n)).alias(n) for n in ("mean", "std", "min", "max", "share")])


AUC = "(select (sum(rank) filter (where is_it) - sum(cast(is_it as int)) * (sum(cast(is_it as int)) + 1) / 2.0) / (sum(cast(is_it as int)) * sum(1 - cast(is_it as int))) from (select regime = '{x}' as is_it, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rank from days))"
FITNESS = f"""{TRUTH},
two as (select score, regime = 'BULL' as high from days where regime <> 'FLAT'),
gaps as (select sum(cast(high as int)) over (order by score) * 1.0 / sum(cast(high as int)) over () - sum(1 - cast(high as int)) over (order by score) * 1.0 / sum(1 - cast(high as int)) over () as gap from two),
sep as (select 1 - {AUC.format(x='BEAR')} as auc_low, {AUC.format(x='BULL')} as auc_high, (select max(abs(gap)) from gaps) as ks,
  (select (avg(score) filter (where high) - avg(score) filter (where not high)) / sqrt(((count(*) filter (where high) - 1) * var_samp(score) filter (where high) + (count(*) filter (where not high) - 1) * var_samp(score) filter (where not high)) / (count(*) - 2)) from two) as cohens_d,
  (select count(*) from lags) as n_periods, (select avg(lag_days) from lags) as avg_lag, (select max(lag_days) from lags) as max_lag)"""


@query("m20_fitness", with_views(*VIEWS, more=FITNESS, sql=f"""select n_periods, cast(max_lag as int) as max_lag, {', '.join(f'{rounded_sql(n)} as {n}' for n in ('auc_low', 'auc_high', 'cohens_d', 'ks', 'avg_lag'))},
{rounded_sql(f'0.6e0 * auc_low + 0.4e0 * auc_high - {rg.LAG_COST}e0 * greatest(coalesce(avg_lag, 0) - {rg.FREE_LAG}, 0)')} as fitness from sep"""))
def m20_fitness(spark, sf_dir):
    d = rg.fitness(days_of(spark, sf_dir))
    return d.select("n_periods", "max_lag", *[rounded(F.col(n)).alias(n) for n in ("auc_low", "auc_high", "cohens_d", "ks", "avg_lag", "fitness")])
