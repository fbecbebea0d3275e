"""Alpha primitives (F) and factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import alphas as a
from barsmith.plans.base import Later, over, query, with_views
from barsmith.plans.features import C, L, chg, features, lag, rounded, rounded_sql
from barsmith.sources import tables as t


def full(sql: str, x: str, n: int) -> str:
    return f"case when count({x}) {over(n)} = {n} then {sql} end"


A = Later(lambda: a)
V = "cast(volume as double)"
features("f1_rolling_aggregates", [(f"{k}_10", f("close", 10), full(f"{g}(close) {over(10)}", "close", 10)) for k, f, g in (("sum", C.ts_sum, "sum"), ("mean", C.ts_mean, "avg"), ("std", C.ts_std, "stddev_samp"), ("min", C.ts_min, "min"), ("max", C.ts_max, "max"))])
features("f2_rolling_correlation", [("cor", C.ts_corr("ra", "rb", 10), full(f"covar_samp(ra, rb) {over(10)} / nullif(stddev_samp(ra) {over(10)} * stddev_samp(rb) {over(10)}, 0)", "(ra + rb)", 10)), ("cov", C.ts_cov("ra", "rb", 10), full(f"covar_samp(ra, rb) {over(10)}", "(ra + rb)", 10))],
         [("ra", L.col("close") / L.col("open"), "close / open"), ("rb", L.col("volume").cast("double"), V)])
LIST = f"list(close) {over(10)}"
features("f3_ts_rank", [("r", C.ts_rank("close", 10), full("(len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / 10", "close", 10))], [("l", C.ts_list("close", 10), LIST)])
features("f4_product", [("p", C.ts_product("q", 5), full("list_reduce(l, lambda x, y: x * y)", "q", 5))], [("q", L.col("close") / L.col("open"), "close / open"), ("l", C.ts_list("q", 5), f"list(q) {over(5)}")])
features("f5_delta_delay", [("d3", C.delta("close", 3), f"close - {lag('close', 3)}"), ("l3", C.delay("close", 3), lag("close", 3))])
features("f8_argmax", [("hi", C.ts_argmax("close", 10), full("list_position(l, list_max(l))", "close", 10)), ("lo", C.ts_argmin("close", 10), full("list_position(l, list_min(l))", "close", 10))], [("l", C.ts_list("close", 10), LIST)])
features("f9_decay_linear", [("d", C.decay_linear("close", 4), f"(1 * {lag('close', 3)} + 2 * {lag('close', 2)} + 3 * {lag('close', 1)} + 4 * close) / 10")])
features("f7_scale", [("s", A.scale("close"), "close / nullif(sum(abs(close)) over (partition by date), 0)")])

RANK = "case when {x} is not null then (rank() over (partition by date order by {x} nulls last) + (count(*) over (partition by date, {x}) - 1) / 2.0) / count({x}) over (partition by date) end"


def rk(x: str) -> str:
    return RANK.format(x=x)


SLOPE = f"(({lag('close', 20)} - {lag('close', 10)}) / 10 - ({lag('close', 10)} - close) / 10)"
STAGE1 = f"""a0 as (select *, (high + low + close) / 3 as vwap, {chg('close')} as returns, close - {lag('close')} as dc, volume - {lag('volume')} as dv from bars),
a1 as (select *, case when returns < 0 then {full(f'stddev_samp(returns) {over(20)}', 'returns', 20)} else close end as b1,
  {full(f'sum(open) {over(5)}', 'open', 5)} * {full(f'sum(returns) {over(5)}', 'returns', 5)} as p8 from a0),
a2 as (select *, sign(b1) * b1 * b1 as base1 from a1),
a3 as (select *, {full('list_position(l1, list_max(l1))', 'base1', 5)} as t1, ln(volume) - ln({lag('volume', 2)}) as t2a, (close - open) / open as t2b, p8 - {lag('p8', 10)} as t8,
  {full(f'max(vwap - close) {over(3)}', '(vwap - close)', 3)} as t11a, {full(f'min(vwap - close) {over(3)}', '(vwap - close)', 3)} as t11b, volume - {lag('volume', 3)} as t11c,
  1 + {full(f'sum(returns) {over(250)}', 'returns', 250)} as t19, 2 * (close - {lag('close', 7)}) as gain7
  from (select *, list(base1) {over(5)} as l1 from a2)),
a4 as (select *, {', '.join(f'{rk(x)} as r_{x}' for x in ('open', 'high', 'low', 'close', 'volume', 't1', 't2a', 't2b', 't8', 't11a', 't11b', 't11c', 't19'))} from a3),
a5 as (select *, {full(f'covar_samp(r_close, r_volume) {over(5)}', '(r_close + r_volume)', 5)} as t13, list(r_low) {over(9)} as llow from a4)"""
ALPHA_SQL = {
    "alpha001": "r_t1 - 0.5",
    "alpha004": f"-({full('(len(list_filter(llow, lambda v: v < r_low)) + (len(list_filter(llow, lambda v: v = r_low)) + 1) / 2) / 9', 'r_low', 9)})",
    "alpha008": "-r_t8", "alpha011": "(r_t11a + r_t11b) * r_t11c", "alpha012": "sign(dv) * -dc",
    "alpha019": "-sign(gain7) * (1 + r_t19)", "alpha041": "sqrt(high * low) - vwap",
    "alpha009": f"case when {full(f'min(dc) {over(5)}', 'dc', 5)} > 0 then dc when {full(f'max(dc) {over(5)}', 'dc', 5)} < 0 then dc else -dc end",
    "alpha046": f"case when {SLOPE} > 0.25 then -1.0 when {SLOPE} < 0 then 1.0 else -dc end", "alpha049": f"case when {SLOPE} < -0.1 then 1.0 else -dc end", "alpha051": f"case when {SLOPE} < -0.05 then 1.0 else -dc end",
    "alpha054": "-(low - close) * pow(open, 5) / nullif((low - high) * pow(close, 5), 0)", "alpha101": "(close - open) / (high - low + 0.001)",
}


@query("alphas_time_and_day", with_views("bars", more=STAGE1, sql="select ticker, date, " + ", ".join(f"{rounded_sql(s)} as {n}" for n, s in ALPHA_SQL.items()) + " from a5"))
def production_alphas(spark, sf_dir):
    return a.alphas(t.bars(spark, sf_dir)).select("ticker", "date", *[rounded(F.col(n)).alias(n) for n in ALPHA_SQL])


# Correlations of short windows of ranks are ill-conditioned where a window is nearly constant: rows only.
@query("alphas_of_ranked_windows")
def ranked_alphas(spark, sf_dir):
    return a.alphas(t.bars(spark, sf_dir)).select("ticker", "date", *[rounded(F.col(n)).alias(n) for n in a.FORMULAS if n not in ALPHA_SQL])


@query("f10_winsorise")
def winsorise(spark, sf_dir):
    return a.winsorised(t.bars(spark, sf_dir).select("ticker", "date", "close", "open"), ["close", "open"])


