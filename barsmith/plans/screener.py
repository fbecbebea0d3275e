"""The whole screener table (V1), labels beside its columns (L3) and periods of its entities (C3), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import screener as sc
from barsmith.plans.base import LINE, following, over, prior
from barsmith.plans.factors import ALPHA_SQL, STAGE1
from barsmith.plans.features import rounded_sql as r
from barsmith.plans.screening import EMA, rule
from barsmith.sources import tables as t

#: Factors of rolled ranks are ill-conditioned where a window hardly varies: alphas_of_ranked_windows has them.
SHOWN = [n for n in sc.COLUMNS if n not in sc.FACTORS or n in ALPHA_SQL]
BASE = {
    **{f"sma_{n}": f"avg(close) {over(n)}" for n in (20, 50, 150, 200)}, **{f"vol_avg_{n}": f"avg(volume) {over(n)}" for n in (5, 20, 50)}, "vol_before": f"avg(volume) {prior(50)}",
    "volatility_20d": f"stddev_samp(close) {over(20)}", "true_range": "greatest(high - low, abs(high - prev), abs(low - prev))",
    "rs": " + ".join(f"{weight}e0 * (close / nullif(lag(close, {n}) {LINE}, 0) - 1)" for n, weight in sc.STRENGTH.items()),
    "price_vs_spy_ma63": f"avg(price_vs_spy) {over(63)}", "rs_line_log": "ln(price_vs_spy)", "rs_line_delta": f"price_vs_spy / nullif(lag(price_vs_spy) {LINE}, 0) - 1",
    "high_52w": f"max(close) {over(252)}", "low_52w": f"min(close) {over(252)}", "highest_high_20d": f"max(high) {over(20)}", "lowest_low_20d": f"min(low) {over(20)}", "high_20d": f"max(close) {prior(20)}",
}
MORE = {
    **{f"atr_{n}": f"avg(true_range) {over(n)}" for n in (10, 14, 50)}, "atr_20d": f"avg(true_range) {over(20)}", "sma_200_lag20": f"lag(sma_200, 20) {LINE}", "rs_ma": f"avg(rs) {over(63)}",
    **{f"price_vs_sma_{n}": f"(close - sma_{n}) / nullif(sma_{n}, 0) * 100" for n in (50, 150, 200)},
    "dist_from_52w_high": "(close - high_52w) / nullif(high_52w, 0)", "dist_from_52w_low": "close / nullif(low_52w, 0) - 1", "pct_from_high_52w": "(close - high_52w) / nullif(high_52w, 0)",
    "pct_above_low_52w": "(close - low_52w) / nullif(low_52w, 0)", "dist_from_20d_high": "close / nullif(highest_high_20d, 0) - 1", "dist_from_20d_low": "close / nullif(lowest_low_20d, 0) - 1",
    "vol_ratio": "volume / nullif(vol_avg_50, 0)", "dry_up_volume": "vol_avg_5 / nullif(vol_avg_50, 0)", "consolidation_width": "(highest_high_20d - lowest_low_20d) / nullif(close, 0) * 100",
    "close_above_sma200": "coalesce(close > sma_200, false)", "rs_line_uptrend": "coalesce(price_vs_spy > price_vs_spy_ma63, false)",
    "breakout_ok": "coalesce(close > high_20d and volume / nullif(vol_before, 0) > 1.3e0, false)",
}
GROUPS = ", ".join(
    f"case when rs is not null then percent_rank() over (partition by date, {g}, rs is not null order by rs) end as rs_{g}_rank, case when rs is not null then avg(rs_universe_rank) over (partition by date, {g}) end as {g}_momentum,"
    f" case when rs is null then null when stddev_samp(rs_universe_rank) over (partition by date, {g}) > 0 then (rs - avg(rs_universe_rank) over (partition by date, {g})) / stddev_samp(rs_universe_rank) over (partition by date, {g}) else 0 end as rs_vs_{g}" for g in ("sector", "industry"))
TABLE = f"""s0 as (select b.*, sector, industry, close / nullif(spy_close, 0) as price_vs_spy, lag(close) {LINE} as prev from bars b join bench using (date) left join profiles using (ticker)),
s1 as (select *, {', '.join(f'{x} as {n}' for n, x in BASE.items())} from s0),
s2 as (select *, {', '.join(f'{x} as {n}' for n, x in MORE.items())} from s1),
s3 as (select *, atr_14 / nullif(close, 0) * 100 as natr, atr_10 / nullif(atr_50, 0) as vcp_ratio,
  coalesce(close > sma_50 and sma_50 > sma_150 and sma_150 > sma_200 and sma_200 > sma_200_lag20 and close > 1.3e0 * low_52w and close > 0.85e0 * high_52w and price_vs_spy > price_vs_spy_ma63, false) as trend_ok,
  case when rs is not null then percent_rank() over (partition by date, rs is not null order by rs) end as rs_universe_rank from s2),
s4 as (select *, cast(round(rs_universe_rank * 98) + 1 as int) as rs_rating, {GROUPS} from s3),
factors as (select ticker, date, {', '.join(f'{ALPHA_SQL[n]} as {n}' for n in sc.FACTORS if n in ALPHA_SQL)} from a5)"""
WHOLE = {"ticker", "date", "volume", "rs_rating", "close_above_sma200", "rs_line_uptrend", "trend_ok", "breakout_ok"}


@rule("v1_screener_table", ("bars", "bench", "profiles"), f"select {', '.join(n if n in WHOLE else f'{r(n)} as {n}' for n in SHOWN)} from s4 join factors using (ticker, date) join em using (ticker, date)", f"{STAGE1},\n{EMA},\n{TABLE}")
def screener(spark, sf_dir):
    return sc.screener_table(t.bars(spark, sf_dir, lines=True), t.benchmark_series(spark, sf_dir), t.profiles(spark, sf_dir), SHOWN, t.parts(spark, sf_dir))


HORIZONS, FEATURES = (63, 126), ("rs", "price_vs_sma_50", "price_vs_sma_200", "dist_from_52w_high", "vol_ratio", "volatility_20d", "natr", "vcp_ratio", "rs_line_delta")
LABELS = [f"{n}_{h}" for h in HORIZONS for n in ("fwd", "mfe", "mae")]
LABEL_SQL = ", ".join(f"{x} as {n}_{h}" for h in HORIZONS for n, x in (("n", f"count(close) {following(h)}"), ("fwd", f"lead(close, {h}) {LINE}"), ("mfe", f"max(high) {following(h)}"), ("mae", f"min(low) {following(h)}")))


@rule("l3_label_panel", ("bars", "bench", "profiles"), f"select ticker, date, {', '.join(f'{r(n)} as {n}' for n in ('close', *FEATURES))}, "
      + ", ".join(f"{r(f'case when n_{n[4:]} = {n[4:]} then {n} / nullif(close, 0) - 1 end')} as {n}" for n in LABELS) + ", " + ", ".join(f"n_{h} = {h} as full_{h}" for h in HORIZONS) + f" from (select *, {LABEL_SQL} from s3)", f"{STAGE1},\n{TABLE}")
def label_panel(spark, sf_dir):
    return sc.label_panel(t.bars(spark, sf_dir, lines=True), t.benchmark_series(spark, sf_dir), HORIZONS, FEATURES)


SPARSE = 24


@rule("c3_entity_periods", ("fundamentals", "profiles"), f"""select sector, count(*) as entities, {r('avg(n)')} as avg_periods, min(n) as fewest, max(n) as most, count(*) filter (where n < {SPARSE}) as sparse, {r('count(*) filter (where n < ' + str(SPARSE) + ') * 1.0 / count(*)')} as sparse_share,
count(*) filter (where n = 0) as without, cast(sum(n) as bigint) as n_rows from (select p.ticker, any_value(sector) as sector, count(distinct period_end) as n from profiles p left join fundamentals f using (ticker) group by p.ticker) group by sector""")
def entity_periods(spark, sf_dir):
    """Periods of each entity of the profiles by sector: their mean and ends, entities with few or none of them, and rows of a sector."""
    kept = t.fundamentals(spark, sf_dir).groupBy("ticker").agg(F.count_distinct("period_end").alias("n"))
    d = t.profiles(spark, sf_dir).select("ticker", "sector").join(kept, "ticker", "left").fillna(0, ["n"])
    few = F.count_if(F.col("n") < SPARSE)
    return d.groupBy("sector").agg(
        F.count(F.lit(1)).alias("entities"), F.avg("n").alias("avg_periods"), F.min("n").alias("fewest"), F.max("n").alias("most"), few.alias("sparse"), (few / F.count(F.lit(1))).alias("sparse_share"),
        F.count_if(F.col("n") == 0).alias("without"), F.sum("n").alias("n_rows"))
