"""Predicates (P) and rolling features (W) over the bar panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.plans.base import LINE, SO_FAR, Later, following, now, over, prior, query, with_views
from barsmith.sources import tables as t

# Names for expressions that are written down at import and made when a query runs.
L, C, W = Later(lambda: F), Later(lambda: c), Later(lambda: Window)
PANEL, back, before = C.panel(), C.back, C.before

D = 4
#: Prices are multiples of 1/3200, so plain values and means often end in an exact half at the last digit, which
#: engines round differently. Both sides are nudged off it alike.
NUDGE = 3.7e-7


def rounded(x):
    return F.round(x.cast("double") + F.lit(NUDGE), D)


def rounded_sql(x: str) -> str:
    return f"round(cast(({x}) as double) + {NUDGE:e}, {D}) + 0e0"


def features(name: str, columns: list[tuple[str, object, str]], steps: list[tuple[str, object, str]] = (), bench: bool = False) -> None:
    """A query of ticker, date and rounded columns (name, Spark column, SQL), after steps that define others."""
    views = ("bars", "bench") if bench else ("bars",)
    source = "(select b.*, spy_close from bars b join bench using (date))" if bench else "bars"
    for n, _, sql in steps:
        source = f"(select *, {sql} as {n} from {source})"
    text = with_views(*views, sql=f"select ticker, date, {', '.join(f'{rounded_sql(sql)} as {n}' for n, _, sql in columns)} from {source}")

    @query(name, text)
    def run(spark, sf_dir) -> DataFrame:
        df = t.bars(spark, sf_dir)
        if bench:
            df = df.join(t.benchmark_series(spark, sf_dir), "date")
        for n, col, _ in steps:
            df = df.withColumn(n, now(col))
        return df.select("ticker", "date", *[rounded(now(col)).alias(n) for n, col, _ in columns])


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {LINE}"


def chg(x: str, n: int = 1) -> str:
    return f"{x} / nullif({lag(x, n)}, 0) - 1"


features("w1_moving_averages", [(f"sma_{n}", L.avg("close").over(back(n)), f"avg(close) {over(n)}") for n in (5, 10, 15, 20, 50, 150, 200)])
features(
    "w2_relative_strength",
    [("ratio", L.col("ratio"), "ratio"), ("ratio_ma63", L.avg("ratio").over(back(63)), f"avg(ratio) {over(63)}"), ("rs_line_log", L.log("ratio"), "ln(ratio)"),
     ("rs_line_delta", C.change("ratio"), chg("ratio")), ("rs_line_uptrend", (L.col("ratio") > L.avg("ratio").over(back(63))).cast("int"), f"cast(ratio > avg(ratio) {over(63)} as int)")],
    [("ratio", L.col("close") / L.col("spy_close"), "close / spy_close")], bench=True)
features(
    "w3_volume",
    [(f"vol_avg_{n}", L.avg("volume").over(back(n)), f"avg(volume) {over(n)}") for n in (5, 20, 50)]
    + [("vol_avg_50_prev", L.avg("volume").over(before(50)), f"avg(volume) {prior(50)}"),
       ("vol_ratio", C.safe_ratio("volume", L.avg("volume").over(before(50))), f"volume / nullif(avg(volume) {prior(50)}, 0)"),
       ("dry_up_volume", C.safe_ratio(L.avg("volume").over(back(5)), L.avg("volume").over(back(50))), f"avg(volume) {over(5)} / nullif(avg(volume) {over(50)}, 0)")])
features("w4_volatility", [("volatility_20d", L.stddev_samp("close").over(back(20)), f"stddev_samp(close) {over(20)}")])
TRUE_RANGE = ("tr", L.greatest(L.col("high") - L.col("low"), L.abs(L.col("high") - L.col("pc")), L.abs(L.col("low") - L.col("pc"))), "greatest(high - low, abs(high - pc), abs(low - pc))")
PREVIOUS = ("pc", L.lag("close").over(PANEL), lag("close"))
features(
    "w5_true_range",
    [("true_range", L.col("tr"), "tr")] + [(f"atr_{n}", L.avg("tr").over(back(n)), f"avg(tr) {over(n)}") for n in (10, 14, 20, 50)]
    + [("natr", C.safe_ratio(L.avg("tr").over(back(14)), "close") * 100, f"avg(tr) {over(14)} / nullif(close, 0) * 100"),
       ("vcp_ratio", C.safe_ratio(L.avg("tr").over(back(10)), L.avg("tr").over(back(50))), f"avg(tr) {over(10)} / nullif(avg(tr) {over(50)}, 0)")],
    [PREVIOUS, TRUE_RANGE])
features("w6_momentum", [(f"mom_{n}d", C.change("close", n), chg("close", n)) for n in (21, 63, 126, 189, 252)])
features(
    "w7_extremes",
    [("high_52w", L.max("close").over(back(252)), f"max(close) {over(252)}"), ("low_52w", L.min("close").over(back(252)), f"min(close) {over(252)}"),
     ("highest_high_20d", L.max("high").over(back(20)), f"max(high) {over(20)}"), ("lowest_low_20d", L.min("low").over(back(20)), f"min(low) {over(20)}"),
     ("high_20d", L.max("close").over(before(20)), f"max(close) {prior(20)}")])
features(
    "w8_distances",
    [("dist_from_52w_high", C.safe_ratio("close", "hi") - 1, "close / nullif(hi, 0) - 1"), ("dist_from_52w_low", C.safe_ratio("close", "lo") - 1, "close / nullif(lo, 0) - 1"),
     ("pct_from_high_52w", (L.col("hi") - L.col("close")) / L.col("hi") * 100, "(hi - close) / hi * 100"), ("pct_above_low_52w", (L.col("close") - L.col("lo")) / L.col("lo") * 100, "(close - lo) / lo * 100")],
    [("hi", L.max("close").over(back(252)), f"max(close) {over(252)}"), ("lo", L.min("close").over(back(252)), f"min(close) {over(252)}")])
RATING = ("rs", 0.4 * C.change("close", 63) + 0.2 * (C.change("close", 126) + C.change("close", 189) + C.change("close", 252)),
          f"0.4 * ({chg('close', 63)}) + 0.2 * (({chg('close', 126)}) + ({chg('close', 189)}) + ({chg('close', 252)}))")
features("w9_rating", [("rs_raw", L.col("rs"), "rs"), ("rs_ma", L.avg("rs").over(back(63)), f"avg(rs) {over(63)}")], [RATING])
features(
    "w10_average_ratios",
    [("sma_200_lag20", L.lag("s200", 20).over(PANEL), lag("s200", 20)), ("price_vs_sma_50", C.safe_ratio("close", "s50") - 1, "close / nullif(s50, 0) - 1"),
     ("price_vs_sma_200", C.safe_ratio("close", "s200") - 1, "close / nullif(s200, 0) - 1"), ("close_above_sma200", (L.col("close") > L.col("s200")).cast("int"), "cast(close > s200 as int)"),
     ("consolidation_width", (L.max("high").over(back(20)) - L.min("low").over(back(20))) / L.col("close"), f"(max(high) {over(20)} - min(low) {over(20)}) / close")],
    [(f"s{n}", L.avg("close").over(back(n)), f"avg(close) {over(n)}") for n in (50, 200)])
features("w11_returns", [(f"return_{n}d", C.change("close", n), chg("close", n)) for n in (1, 5, 20, 60)])
features(
    "w12_turnover",
    [("dollar_volume_avg_20", L.avg(L.col("close") * L.col("volume")).over(back(20)), f"avg(close * volume) {over(20)}"),
     ("vol_ratio_50", C.safe_ratio("volume", L.avg("volume").over(back(50))), f"volume / nullif(avg(volume) {over(50)}, 0)"), ("turnover", L.col("close") * L.col("volume"), "close * volume")])
GAINS = [("move", L.col("close") - L.lag("close").over(PANEL), f"close - {lag('close')}"), ("up", L.greatest("move", L.lit(0.0)), "case when move is null then 0 else greatest(move, 0) end"),
         ("down", L.greatest(-L.col("move"), L.lit(0.0)), "case when move is null then 0 else greatest(-move, 0) end")]
features(
    "w13_rsi",
    [("rsi_14_as_coded", 100 / (1 + L.col("ratio")), "100 / (1 + ratio)"), ("rsi_14", 100 - 100 / (1 + L.col("ratio")), "100 - 100 / (1 + ratio)")],
    [*GAINS, ("ratio", C.safe_ratio(L.avg("up").over(back(14)), L.avg("down").over(back(14))), f"avg(up) {over(14)} / nullif(avg(down) {over(14)}, 0)")])
features(
    "w14_breakout_days",
    [("breakout", L.coalesce(L.col("close") > L.max("close").over(before(20)), L.lit(False)).cast("int"), f"cast(coalesce(close > max(close) {prior(20)}, false) as int)"),
     ("is_green_day", (L.col("close") > L.col("open")).cast("int"), "cast(close > open as int)"), ("green_days_ratio_20d", L.avg((L.col("close") > L.col("open")).cast("double")).over(back(20)), f"avg(cast(close > open as double)) {over(20)}"),
     ("adr_20d", L.avg(L.col("high") / L.col("low") - 1).over(back(20)) * 100, f"avg(high / low - 1) {over(20)} * 100")])
features(
    "w15_percent_changes",
    [(f"{x}_pct_chg", C.abs_change_pct(x), f"({x} - {lag(x)}) / nullif(abs({lag(x)}), 0) * 100") for x in ("close", "volume", "s20")]
    + [("zero_aware", C.zero_aware_change_pct("gap"), f"case when {lag('gap')} is null then null when {lag('gap')} = 0 and gap = 0 then 0 when {lag('gap')} = 0 then 100 else (gap - {lag('gap')}) / abs({lag('gap')}) * 100 end")],
    [("s20", L.avg("close").over(back(20)), f"avg(close) {over(20)}"), ("gap", L.greatest(L.col("close") - L.col("open"), L.lit(0.0)), "greatest(close - open, 0.0)")])
features(
    "w16_slopes",
    [("sma_ratio", C.safe_ratio("s50", "s200"), "s50 / nullif(s200, 0)"), ("sma_50_slope", C.change("s50", 10), chg("s50", 10)), ("mom_slope", L.col("m21") - L.lag("m21", 5).over(PANEL), f"m21 - {lag('m21', 5)}"),
     ("gap_risk_ratio", C.safe_ratio(L.abs(L.col("open") - L.lag("close").over(PANEL)), "close"), f"abs(open - {lag('close')}) / nullif(close, 0)")],
    [("s50", L.avg("close").over(back(50)), f"avg(close) {over(50)}"), ("s200", L.avg("close").over(back(200)), f"avg(close) {over(200)}"), ("m21", C.change("close", 21), chg("close", 21))])
features(
    "w17_second_differences",
    [("volume_acceleration", L.col("v5") - 2 * L.lag("v5", 1).over(PANEL) + L.lag("v5", 2).over(PANEL), f"v5 - 2 * {lag('v5', 1)} + {lag('v5', 2)}"),
     ("consolidation_duration", L.sum((L.col("high") / L.col("low") < 1.5).cast("int")).over(back(20)), f"sum(cast(high / low < 1.5 as int)) {over(20)}"),
     ("volume_velocity_2d", L.log(C.safe_ratio("volume", L.lag("volume", 2).over(PANEL))), f"ln(volume / nullif({lag('volume', 2)}, 0))"),
     ("price_accel_10d", C.change("close", 10) - L.lag("m10", 10).over(PANEL), f"({chg('close', 10)}) - {lag('m10', 10)}")],
    [("v5", L.avg("volume").over(back(5)), f"avg(volume) {over(5)}"), ("m10", C.change("close", 10), chg("close", 10))])
features(
    "w18_vol_adjusted",
    [("mom_per_vol", L.when(L.count("r").over(back(21)) >= 10, C.safe_ratio("m21", L.stddev_samp("r").over(back(21)))), f"case when count(r) {over(21)} >= 10 then m21 / nullif(stddev_samp(r) {over(21)}, 0) end")],
    [("r", C.change("close"), chg("close")), ("m21", C.change("close", 21), chg("close", 21))])
features(
    "w20_rolling_slope",
    [("slope", L.when(L.count("y").over(back(63)) == 63, L.regr_slope("y", "x").over(back(63))), f"case when count(y) {over(63)} = 63 then regr_slope(y, x) {over(63)} end"),
     ("r2", L.when(L.count("y").over(back(63)) == 63, L.regr_r2("y", "x").over(back(63))), f"case when count(y) {over(63)} = 63 then regr_r2(y, x) {over(63)} end"),
     ("prior_sign", L.signum(L.col("y") - L.lag("y", 252).over(PANEL)), f"sign(y - {lag('y', 252)})")],
    [("x", L.row_number().over(PANEL).cast("double"), f"cast(row_number() {LINE} as double)"), ("y", L.log("close"), "ln(close)")])
features("w23_rolling_z", [("z", L.when(L.count("close").over(back(100)) == 100, C.safe_ratio(L.col("close") - L.avg("close").over(back(100)), L.stddev_samp("close").over(back(100)))),
                            f"case when count(close) {over(100)} = 100 then (close - avg(close) {over(100)}) / nullif(stddev_samp(close) {over(100)}, 0) end")])
features("w24_rolling_percentile", [("pct", C.rolling_percentile("seen", "close", 60), "case when len(seen) = 60 then len(list_filter(seen, lambda v: v < close)) / 59 end")],
         [("seen", C.ts_list("close", 60), f"list(close) {over(60)}")])
EXPAND = PANEL.rowsBetween(Window.unboundedPreceding, -1)
UNTIL = "over (partition by ticker order by date rows between unbounded preceding and 1 preceding)"
features("w26_expanding", [("mean_before", L.avg("close").over(EXPAND), f"avg(close) {UNTIL}"), ("std_before", L.stddev_samp("close").over(EXPAND), f"stddev_samp(close) {UNTIL}")])
features("w28_min_periods", [("mean_20", L.avg("r").over(back(20)), f"avg(r) {over(20)}"), ("std_20", L.when(L.count("r").over(back(20)) >= 5, L.stddev_samp("r").over(back(20))), f"case when count(r) {over(20)} >= 5 then stddev_samp(r) {over(20)} end")],
         [("r", C.change("close"), chg("close"))])
features("w30_rolling_sharpe", [("sharpe", L.when(L.count("r").over(back(126)) == 126, C.safe_ratio(L.avg("r").over(back(126)), L.stddev_samp("r").over(back(126))) * 252**0.5),
                                 f"case when count(r) {over(126)} = 126 then avg(r) {over(126)} / nullif(stddev_samp(r) {over(126)}, 0) * sqrt(252) end")], [("r", C.change("close"), chg("close"))])
RUN = PANEL.rowsBetween(Window.unboundedPreceding, 0)
features("w31_drawdown", [("peak", L.max("close").over(RUN), f"max(close) {SO_FAR}"), ("drawdown", L.col("close") / L.max("close").over(RUN) - 1, f"close / max(close) {SO_FAR} - 1"),
                          ("log_growth", L.sum(L.coalesce(L.log1p("r"), L.lit(0.0))).over(RUN), f"sum(coalesce(ln(1 + r), 0)) {SO_FAR}")], [("r", C.change("close"), chg("close"))])
features("w32_forward", [("max_20", L.max("high").over(C.ahead(20)), f"max(high) {following(20)}"), ("min_20", L.min("low").over(C.ahead(20)), f"min(low) {following(20)}"),
                         ("n_20", L.count("close").over(C.ahead(20)), f"count(close) {following(20)}"), ("lead_20", L.lead("close", 20).over(PANEL), f"lead(close, 20) {LINE}")])
features("w33_forward_return_guard", [("fwd_5", L.when(L.date_diff(L.lead("date", 5).over(PANEL), "date") <= 25, L.lead("close", 5).over(PANEL) / L.col("close") - 1),
                                       f"case when date_diff('day', date, lead(date, 5) {LINE}) <= 25 then lead(close, 5) {LINE} / close - 1 end")])
features("w34_change_detection", [("flipped", L.coalesce(L.col("up") != L.lag("up").over(PANEL), L.lit(False)).cast("int"), f"cast(coalesce(up <> {lag('up')}, false) as int)")],
         [("up", L.col("close") > L.col("open"), "close > open")])
DAY = "over (partition by date order by close)"
features("w36_percent_rank", [("pr", C.percent_rank("close"), f"percent_rank() {DAY}"), ("rating", L.floor(C.percent_rank("close") * 98 + 1), f"floor(percent_rank() {DAY} * 98 + 1)")])
features("w37_day_rank", [("dr", C.day_rank("volume"), "(rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0) / count(volume) over (partition by date)")])
features("w38_first_rank", [("rk", L.row_number().over(W.partitionBy("date").orderBy(L.desc("close"), "ticker")), "row_number() over (partition by date order by close desc, ticker)")])
features("w39_ntile", [("decile", L.ntile(10).over(W.partitionBy("date").orderBy("close", "ticker")), "ntile(10) over (partition by date order by close, ticker)")])
features("w41_rank_mean", [("rank_mean_10", L.when(L.count("pr").over(back(10)) == 10, L.avg("pr").over(back(10))), f"case when count(pr) {over(10)} = 10 then avg(pr) {over(10)} end")], [("pr", C.percent_rank("close"), f"percent_rank() {DAY}")])
features("w42_persistence", [("persistent", (L.sum((L.col("pr") >= 0.8).cast("int")).over(back(5)) >= 2).cast("int"), f"cast(sum(cast(pr >= 0.8 as int)) {over(5)} >= 2 as int)")], [("pr", C.percent_rank("close"), f"percent_rank() {DAY}")])

# Relaxed template on test data: averages over 5, 10 and 15 bars, extremes over 25.
TEMPLATE_STEPS = [(f"s{n}", L.avg("close").over(back(n)), f"avg(close) {over(n)}") for n in (5, 10, 15)] + [
    ("hi", L.max("close").over(back(25)), f"max(close) {over(25)}"), ("lo", L.min("close").over(back(25)), f"min(close) {over(25)}"),
    ("top", L.max("close").over(before(20)), f"max(close) {prior(20)}"), ("va", L.avg("volume").over(before(10)), f"avg(volume) {prior(10)}")]
TREND = L.coalesce((L.col("close") > L.col("s10")) & (L.col("close") > L.col("s15")) & (L.col("s10") > L.col("s15")) & (L.col("s5") > L.col("s10")) & (L.col("close") > L.col("s5"))
                   & (L.col("close") > 1.1 * L.col("lo")) & (L.col("close") > 0.7 * L.col("hi")), L.lit(False))
TREND_SQL = "coalesce(close > s10 and close > s15 and s10 > s15 and s5 > s10 and close > s5 and close > 1.1 * lo and close > 0.7 * hi, false)"
BREAKOUT = L.coalesce((L.col("close") > L.col("top")) & (L.col("volume") / L.nullif("va", L.lit(0.0)) > 1.0), L.lit(False))
BREAKOUT_SQL = "coalesce(close > top and volume / nullif(va, 0) > 1.0, false)"
features("p1_trend_template", [("trend_ok", TREND.cast("int"), f"cast({TREND_SQL} as int)")], TEMPLATE_STEPS)
features("p2_breakout", [("breakout_ok", BREAKOUT.cast("int"), f"cast({BREAKOUT_SQL} as int)")], TEMPLATE_STEPS)


def flagged(spark, sf_dir) -> DataFrame:
    """Bars with the template's steps, trend_ok and breakout_ok."""
    df = t.bars(spark, sf_dir, lines=True)
    for n, col, _ in TEMPLATE_STEPS:
        df = df.withColumn(n, now(col))
    return df.withColumn("trend_ok", now(TREND)).withColumn("breakout_ok", now(BREAKOUT))


FLAGGED = f"""flagged as (
  select *, {TREND_SQL} as trend_ok, {BREAKOUT_SQL} as breakout_ok from (select *, {', '.join(f'{sql} as {n}' for n, _, sql in TEMPLATE_STEPS)} from bars))"""
P3 = [("above_s5", L.col("close") > L.col("s5"), "close > s5"), ("above_s15", L.col("close") > L.col("s15"), "close > s15"), ("near_high", L.col("close") > 0.7 * L.col("hi"), "close > 0.7 * hi")]


@query("p3_criteria_matrix", with_views("bars", more=FLAGGED, sql="select ticker, date, " + ", ".join(f"case when {s} then 'Y' else '.' end as {n}" for n, _, s in P3) + " from flagged"))
def p3(spark, sf_dir):
    return flagged(spark, sf_dir).select("ticker", "date", *[F.when(now(x), "Y").otherwise(".").alias(n) for n, x, _ in P3])


@query("p4_transitions", with_views("bars", more=FLAGGED, sql=f"""
select ticker, date, case when breakout_ok then 'BREAKOUT' when trend_ok and not was then 'ON' else 'OFF' end as change,
  array_to_string(list_filter([{', '.join(f"case when {s} then null else '{n}' end" for n, _, s in P3)}], lambda x: x is not null), ',') as failed
from (select *, coalesce(lag(trend_ok) {LINE}, false) as was from flagged) where breakout_ok or trend_ok <> was"""))
def p4(spark, sf_dir):
    d = flagged(spark, sf_dir).withColumn("was", F.coalesce(F.lag("trend_ok").over(c.panel()), F.lit(False))).where("breakout_ok or trend_ok <> was")
    change = F.when(F.col("breakout_ok"), "BREAKOUT").when(F.col("trend_ok") & ~F.col("was"), "ON").otherwise("OFF")
    return d.select("ticker", "date", change.alias("change"), F.array_join(F.array_compact(F.array(*[F.when(now(x), None).otherwise(F.lit(n)) for n, x, _ in P3])), ",").alias("failed"))


features("p6_universe_predicate", [("passes", L.coalesce((L.col("close") >= 500) & (L.avg("volume").over(back(20)) >= 25), L.lit(False)).cast("int"), f"cast(coalesce(close >= 500 and avg(volume) {over(20)} >= 25, false) as int)")])
features("p11_p12_safe_arithmetic", [("pct", C.abs_change_pct("close"), f"(close - {lag('close')}) / nullif(abs({lag('close')}), 0) * 100"), ("slog", C.signed_log(L.col("close") - L.col("open")), "sign(close - open) * ln(1 + abs(close - open))")])
EDGES = (-0.05, 0.0, 0.05)
features("p14_class_bins", [("cls", C.bin_class("r", EDGES), "case when r is null or r <= -0.05 then 0 when r <= 0 then 1 when r <= 0.05 then 2 else 3 end")], [("r", C.change("close"), chg("close"))])
features("p15_bands", [("weight", C.band("volume", (0, 20, 40, 60), (1.0, 0.75, 0.5), 0.25), "case when volume >= 0 and volume < 20 then 1.0 when volume < 40 then 0.75 when volume < 60 then 0.5 else 0.25 end")])
features("p25_clamp", [("close_ok", L.when(L.col("close") > 2000, None).otherwise(L.col("close")), "case when close > 2000 then null else close end")])


@query("p16_threshold_labels", with_views("scores", sql="select ticker, date, case when score >= 0.8 then 'strong' when score >= 0.6 then 'good' when score >= 0.4 then 'fair' else 'weak' end as label from scores"))
def p16(spark, sf_dir):
    return t.scores(spark, sf_dir).select("ticker", "date", c.threshold_label("score", [(0.8, "strong"), (0.6, "good"), (0.4, "fair")], "weak").alias("label"))


@query("p10_last_days", with_views("bars", sql="select ticker, date, close from bars where date >= (select max(date) from bars) - 90"))
def p10(spark, sf_dir):
    b = t.bars(spark, sf_dir)
    return b.crossJoin(F.broadcast(b.agg(F.max("date").alias("m")))).where(F.col("date") >= F.date_sub("m", 90)).select("ticker", "date", "close")


@query("p22_category_codes", "select s_suppkey, case r_name when 'AFRICA' then 0 when 'AMERICA' then 1 when 'ASIA' then 2 end as code from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def p22(spark, sf_dir):
    s, n, r = (t.table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", c.encode_categories("r_name", ("AFRICA", "AMERICA", "ASIA")).alias("code"))


@query("p27_warmup_clip", with_views("bars", sql=f"select ticker, date, s from (select *, sum(cast(s is not null as int)) {SO_FAR} as n from (select ticker, date, {rounded_sql(f'case when count(close) {over(50)} = 50 then avg(close) {over(50)} end')} as s from bars)) where n > 0"))
def p27(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date", rounded(c.ts_mean("close", 50)).alias("s"))
    return d.withColumn("n", F.sum(F.col("s").isNotNull().cast("int")).over(now(RUN))).where("n > 0").select("ticker", "date", "s")
