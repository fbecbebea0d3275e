"""Signals: feature tables, calibration, regimes and parity (T), cohorts and feeds (V), gauges (M), documents (X, K, L), more checks (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions import columns as c
from barsmith.functions.columns import day_rank, panel
from barsmith.operators import joins as j
from barsmith.operators import quality as q
from barsmith.operators import series as se
from barsmith.operators import text as tx
from barsmith.plans.base import LINE, over, query, with_views
from barsmith.plans.factors import rk
from barsmith.plans.features import FLAGGED, flagged
from barsmith.plans.features import rounded_sql as r
from barsmith.plans.markets import WIDE, day_line, filled
from barsmith.plans.screening import ON_TRADES, paths, rule
from barsmith.plans.statistics import PANEL_SQL, scored, stat
from barsmith.plans.timeline import SESSIONS, sessions_of
from barsmith.sources import tables as t

# ---- features against a target

FEATURES = {"mom": f"close / lag(close, 10) {LINE} - 1", "vol": f"stddev_samp(close) {over(10)} / nullif(avg(close) {over(10)}, 0)", "score": "score"}
FEATURED = f"ft as (select ticker, date, lead(close, 5) {LINE} / close - 1 as fwd, {', '.join(f'{x} as {n}' for n, x in FEATURES.items())} from scores)"
LONG = "lg as (" + " union all ".join(f"select date, ticker, '{n}' as feature, {n} as x, fwd from ft where {n} is not null and fwd is not null" for n in FEATURES) + ")"


def featured(spark, sf_dir):
    w, close = panel(), F.col("close")
    return t.scores(spark, sf_dir, lines=True).select(
        "ticker", "date", (F.lead("close", 5).over(w) / close - 1).alias("fwd"), (close / F.lag("close", 10).over(w) - 1).alias("mom"),
        (F.stddev_samp("close").over(c.back(10)) / F.nullif(F.avg("close").over(c.back(10)), F.lit(0.0))).alias("vol"), "score")


def ranked_days(spark, sf_dir):
    """Feature rows of full windows, dealt out by day: every rank is a sort, and a task holds the sorts of all ranked columns."""
    return featured(spark, sf_dir).where("mom is not null and vol is not null").repartition(t.parts(spark, sf_dir), "date")


def unpivoted(spark, sf_dir):
    return featured(spark, sf_dir).unpivot(["ticker", "date", "fwd"], list(FEATURES), "feature", "x").where("x is not null and fwd is not null")


@rule("t4_feature_ic", ("scores",), f"select feature, {r('corr(a, b)')} as ic, count(*) as n, abs(corr(a, b)) < 0.02 as low_signal from (select feature, percent_rank() over (partition by feature, date order by x) as a, percent_rank() over (partition by feature, date order by fwd) as b from lg) group by feature having count(*) >= 50", f"{FEATURED},\n{LONG}")
def t4(spark, sf_dir):
    rank = lambda x: F.percent_rank().over(Window.partitionBy("feature", "date").orderBy(x))
    d = unpivoted(spark, sf_dir).select("feature", rank("x").alias("a"), rank("fwd").alias("b"))
    return d.groupBy("feature").agg(F.corr("a", "b").alias("ic"), F.count(F.lit(1)).alias("n"), (F.abs(F.corr("a", "b")) < 0.02).alias("low_signal")).where("n >= 50")


PAIRS = [("mom", "vol"), ("mom", "score"), ("vol", "score")]


@rule("t5_redundant_features", ("scores",), " union all ".join(f"select '{a}' as f, '{b}' as g, {r('corr(ra, rb)')} as spearman, abs(corr(ra, rb)) > 0.5 as redundant from (select {rk(a)} as ra, {rk(b)} as rb from ft where mom is not null and vol is not null)" for a, b in PAIRS), FEATURED)
def t5(spark, sf_dir):
    d = ranked_days(spark, sf_dir).select(*[day_rank(n).alias(n) for n in FEATURES])
    one = d.agg(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("g"), F.corr(a, b).alias("spearman"), (F.abs(F.corr(a, b)) > 0.5).alias("redundant")).alias(f"{a}_{b}") for a, b in PAIRS])
    return one.select(F.inline(F.array(*[f"{a}_{b}" for a, b in PAIRS])))


DECILES = "dc as (select p.*, least(cast(floor(score * 10) as int), 9) as bucket from p)"
stat("t8_decile_profile", f"select bucket, count(*) as n, {r('min(score)')} as pmin, {r('max(score)')} as pmax, {r('avg(fwd)')} as mean, {r('median(fwd)')} as median, {r('quantile_cont(fwd, 0.9)')} as p90 from dc group by bucket", DECILES)(
    lambda p: p.withColumn("bucket", F.least(F.floor(F.col("score") * 10).cast("int"), F.lit(9))).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("pmin"), F.max("score").alias("pmax"), F.avg("fwd").alias("mean"), F.median("fwd").alias("median"), F.percentile("fwd", F.lit(0.9)).alias("p90")))
stat("t18_threshold_calibration", f"select bucket / 10e0 as threshold, count(*) as n, {r('avg(up)')} as rate, {r('avg(up) - avg(score)')} as gap from dc where bucket >= 5 group by bucket".replace("bucket / 10e0", r("bucket / 10e0")), DECILES)(
    lambda p: p.withColumn("bucket", F.least(F.floor(F.col("score") * 10).cast("int"), F.lit(9))).where("bucket >= 5").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg("up").alias("rate"), (F.avg("up") - F.avg("score")).alias("gap")).select((F.col("bucket") / 10.0).alias("threshold"), "n", "rate", "gap"))
stat("t20_calibrated_scores", f"select ticker, date, {r('rate')} as calibrated from dc join (select bucket, avg(up) as rate from dc where date < date '1998-01-01' group by bucket) using (bucket) where date >= date '1998-01-01'", DECILES)(
    lambda p: _calibrated(p.withColumn("bucket", F.least(F.floor(F.col("score") * 10).cast("int"), F.lit(9)))))


def _calibrated(d):
    table = d.where("date < '1998-01-01'").groupBy("bucket").agg(F.avg("up").alias("calibrated"))
    return d.where("date >= '1998-01-01'").join(F.broadcast(table), "bucket").select("ticker", "date", "calibrated")  # ten rows


stat("t24_metrics_by_bucket", f"select year(date) as y, ntile as quintile, count(*) as n, {r('avg(fwd)')} as mean, {r('avg(up)')} as win_rate from (select *, ntile(5) over (partition by date order by score, ticker) as ntile from p) group by 1, 2")(
    lambda p: p.withColumn("quintile", F.ntile(5).over(Window.partitionBy("date").orderBy("score", "ticker"))).groupBy(F.year("date").cast("long").alias("y"), "quintile").agg(F.count(F.lit(1)).alias("n"), F.avg("fwd").alias("mean"), F.avg("up").alias("win_rate")))
stat("t26_score_around_events", f"select d, count(*) as n, {r('avg(x.score)')} as mean_score from (select e.ticker, x.score, date_diff('day', e.date, x.date) as d from p e join p x on x.ticker = e.ticker and x.date between e.date - 10 and e.date + 10 where e.score >= 0.99) x group by d")(
    lambda p: _around(p))


def _around(p, days: int = 10):
    """Events meet the scores of the days around them by day, not by range: each event names its days."""
    e = p.where("score >= 0.99").select("ticker", "date", F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("d"))
    e = e.select("ticker", F.date_add("date", F.col("d")).alias("date"), "d")
    return e.join(p.select("ticker", "date", "score"), ["ticker", "date"]).groupBy(F.col("d").cast("long").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


stat("t30_trade_sharpe", f"select {r('avg(fwd) / nullif(stddev_samp(fwd), 0) * sqrt(count(*))')} as sharpe, {r('sum(fwd)')} as total from p where score >= 0.9")(
    lambda p: p.where("score >= 0.9").agg((F.avg("fwd") / F.nullif(F.stddev_samp("fwd"), F.lit(0.0)) * F.sqrt(F.count(F.lit(1)))).alias("sharpe"), F.sum("fwd").alias("total")))
CELLS = "cl as (select year(date) as y, quarter(date) as k, avg(fwd) / nullif(stddev_samp(fwd), 0) as sharpe from p where score >= 0.8 group by 1, 2 having count(*) > 2)"
stat("t31_b7_cone", f"select y, count(sharpe) as cells, {r('median(sharpe)')} as mid, {r('quantile_cont(sharpe, 0.25)')} as low, {r('quantile_cont(sharpe, 0.75)')} as high, {r('min(sharpe)')} as worst, {r('avg(cast(sharpe < 0 as int))')} as negative from cl group by y", CELLS)(lambda p: _cone(p))


def _cone(p):
    cells = p.where("score >= 0.8").groupBy(F.year("date").cast("long").alias("y"), F.quarter("date").alias("k")).agg((F.avg("fwd") / F.nullif(F.stddev_samp("fwd"), F.lit(0.0))).alias("sharpe"), F.count(F.lit(1)).alias("n")).where("n > 2")
    at = lambda x: F.percentile("sharpe", F.lit(x))
    return cells.groupBy("y").agg(F.count("sharpe").alias("cells"), F.median("sharpe").alias("mid"), at(0.25).alias("low"), at(0.75).alias("high"), F.min("sharpe").alias("worst"), F.avg((F.col("sharpe") < 0).cast("int")).alias("negative"))


stat("t34_fold_summary", f"select count(*) as folds, {r('avg(m)')} as mean, {r('stddev_samp(m)')} as std, {r('min(m)')} as worst, min(m) > -1 as gate from (select year(date) as y, avg(fwd) as m from p group by 1)")(
    lambda p: p.groupBy(F.year("date").alias("y")).agg(F.avg("fwd").alias("m")).agg(F.count(F.lit(1)).alias("folds"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), F.min("m").alias("worst"), (F.min("m") > -1).alias("gate")))
stat("t35_feature_parity", f"select count(*) as n, {r('max(abs(a - b))')} as worst, count(*) filter (where a is distinct from b) as mismatches from (select x.score as a, case when x.date < date '1998-01-01' then x.score else round(x.score, 2) end as b from p x)")(
    lambda p: _parity(p, p.select("ticker", "date", F.when(F.col("date") < "1998-01-01", F.col("score")).otherwise(F.round("score", 2)).alias("b"))))


def _parity(a, b):
    d = a.select("ticker", "date", F.col("score").alias("a")).join(b, ["ticker", "date"])
    return d.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("worst"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))


@rule("t36_composite_baseline", ("scores",), f"select ticker, date, {r(f'({rk('mom')} + {rk('vol')}) / 2')} as composite from ft where mom is not null and vol is not null", FEATURED)
def t36(spark, sf_dir):
    return ranked_days(spark, sf_dir).select("ticker", "date", ((day_rank("mom") + day_rank("vol")) / 2).alias("composite"))


stat("t38_leadership_profile", f"select year(date) as era, {r('avg(fwd) filter (where score >= 0.9) - avg(fwd) filter (where score < 0.1)')} as spread, {r('avg(fwd) filter (where score >= 0.9)')} as top from p group by 1")(
    lambda p: p.groupBy(F.year("date").cast("long").alias("era")).agg((F.avg(F.when(F.col("score") >= 0.9, F.col("fwd"))) - F.avg(F.when(F.col("score") < 0.1, F.col("fwd")))).alias("spread"), F.avg(F.when(F.col("score") >= 0.9, F.col("fwd"))).alias("top")))
stat("t40_candidates", f"select ticker, date, {r('score')} as score from (select *, row_number() over (partition by date order by score desc, ticker) as k, percent_rank() over (partition by date order by score) as pr from p where score >= 0.6) where k <= 3 and pr >= 0.5")(
    lambda p: p.where("score >= 0.6").withColumns({"k": F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker")), "pr": F.percent_rank().over(Window.partitionBy("date").orderBy("score"))}).where("k <= 3 and pr >= 0.5").select("ticker", "date", "score"))
stat("t41_expected_outcome", f"select ticker, date, {r('(1 - score) * -0.1 + score * (1 - score) * 0.05 + score * score * 0.3')} as expected, {r('sum(score) over (partition by ticker order by date)')} as running from p")(
    lambda p: p.select("ticker", "date", ((1 - F.col("score")) * -0.1 + F.col("score") * (1 - F.col("score")) * 0.05 + F.col("score") * F.col("score") * 0.3).alias("expected"), F.sum("score").over(panel()).alias("running")))
WINDOWS = [(1996, "1996-01-01", "1997-01-01"), (1997, "1997-01-01", "1998-01-01")]
stat("t43_stitched_folds", " union all ".join(f"select {y} as fold, ticker, date, {r('score')} as score from p where date >= date '{a}' and date < date '{b}'" for y, a, b in WINDOWS))(
    lambda p: p.withColumn("fold", F.coalesce(*[F.when((F.col("date") >= a) & (F.col("date") < b), F.lit(y)) for y, a, b in WINDOWS])).where("fold is not null").select("fold", "ticker", "date", "score"))
stat("t45_gate_rubric", f"select {r('avg(up)')} as value, 1 + cast(avg(up) >= 0.4 as int) + cast(avg(up) >= 0.45 as int) + cast(avg(up) >= 0.5 as int) + cast(avg(up) >= 0.55 as int) as grade from p")(
    lambda p: p.agg(F.avg("up").alias("value")).withColumn("grade", sum((F.when(F.col("value") >= x, 1).otherwise(0) for x in (0.4, 0.45, 0.5, 0.55)), F.lit(1))))
stat("t46_integrity", "select count(*) filter (where score is null or isnan(score)) as unscored, count(*) - count(distinct (ticker, date)) as repeated, count(*) filter (where score < 0 or score > 1) as outside from p")(
    lambda p: p.agg(F.count_if(F.col("score").isNull() | F.isnan("score")).alias("unscored"), (F.count(F.lit(1)) - F.count_distinct("ticker", "date")).alias("repeated"), F.count_if((F.col("score") < 0) | (F.col("score") > 1)).alias("outside")))

# ---- ranks over windows of time

RANKED = f"(1e0 * len(list_filter(xs, lambda v: v < x)) + (1e0 * len(list_filter(xs, lambda v: v = x)) + 1) / 2) / len(xs)"


@rule("w25_rolling_rank", ("macro",), f"select date, case when len(xs) >= 20 then {r(RANKED)} end as pct from (select date, a as x, list(a) over (order by date rows between 59 preceding and current row) as xs from filled where a is not null)", WIDE)
def w25(spark, sf_dir):
    d = filled(spark, sf_dir).where("a is not null").select("date", F.col("a").alias("x"), F.collect_list("a").over(day_line().rowsBetween(-59, 0)).alias("xs"))
    count = lambda f: F.size(F.filter("xs", f)).cast("double")
    pct = (count(lambda v: v < F.col("x")) + (count(lambda v: v == F.col("x")) + 1) / 2) / F.size("xs")
    return d.select("date", F.when(F.size("xs") >= 20, pct).alias("pct"))


SUPPLY = "sp as (select date, count(*) filter (where breakout_ok) * 1.0 / count(*) as share from flagged group by date)"


@rule("m17_supply_share", ("bars",), f"select date, {r('share')} as share, case when share = 0 then 'famine' when share < 0.2 then 'normal' else 'flood' end as regime from sp", f"{FLAGGED},\n{SUPPLY}")
def m17(spark, sf_dir):
    d = flagged(spark, sf_dir).groupBy("date").agg((F.count_if("breakout_ok") / F.count(F.lit(1))).alias("share"))
    return d.select("date", "share", se.ladder([(F.col("share") == 0, "famine"), (F.col("share") < 0.2, "normal")], "flood").alias("regime"))


@rule("w27_smoothed_supply", ("macro",), f"""select date, {r('num / den')} as ema10 from (select date, (select sum(y.a * pow(9e0 / 11, x.k - y.k)) from nm y where y.k <= x.k and y.k > x.k - 200) as num, (select sum(pow(9e0 / 11, x.k - y.k)) from nm y where y.k <= x.k and y.k > x.k - 200) as den from nm x)""",
      f"{WIDE},\nnm as (select date, a, row_number() over (order by date) as k from filled where a is not null)")
def w27(spark, sf_dir):
    d = filled(spark, sf_dir).where("a is not null").select(F.lit("macro").alias("series"), "date", "a")
    return se.ema(d, "series", "date", "a", (10,), adjust=True).select("date", F.col("ema_10").alias("ema10"))


@rule("m13_banded_weights", ("macro",), f"select date, {r('coalesce(lag(w) over (order by date), 1.0)')} as weight from (select date, case when b < 100000 then 1.0 when b < 150000 then 0.6 when b < 200000 then 0.3 when b is not null then 0.0 end as w from filled)", WIDE)
def m13(spark, sf_dir):
    w = F.when(F.col("b") < 100000, 1.0).when(F.col("b") < 150000, 0.6).when(F.col("b") < 200000, 0.3).when(F.col("b").isNotNull(), 0.0)
    return filled(spark, sf_dir).withColumn("w", w).select("date", F.coalesce(F.lag("w").over(day_line()), F.lit(1.0)).alias("weight"))


Z3 = ", ".join(f"({n} - avg({n}) over w) / nullif(stddev_samp({n}) over w, 0) as z{n}" for n in "abx")


@rule("m10_m12_weighted_z", ("macro",), f"select date, {r('0.5 * za + 0.3 * zb + 0.2 * zx')} as z, coalesce(greatest(za, zb, zx) >= 2, false) as veto from (select date, {Z3} from filled window w as (order by date rows between 119 preceding and current row)) where za is not null and zb is not null and zx is not null", WIDE)
def m12(spark, sf_dir):
    w = day_line().rowsBetween(-119, 0)
    d = filled(spark, sf_dir).select("date", *[((F.col(n) - F.avg(n).over(w)) / F.nullif(F.stddev_samp(n).over(w), F.lit(0.0))).alias(f"z{n}") for n in "abx"]).where("za is not null and zb is not null and zx is not null")
    return d.select("date", (0.5 * F.col("za") + 0.3 * F.col("zb") + 0.2 * F.col("zx")).alias("z"), (F.greatest("za", "zb", "zx") >= 2).alias("veto"))


@rule("m23_series_parity", ("bars", "bench"), f"select count(*) as days, {r('max(abs(spy_close - copy))')} as worst, {r('avg(abs(spy_close - copy))')} as mean from (select spy_close, round(spy_close, 2) as copy from bench)")
def m23(spark, sf_dir):
    gap = F.abs(F.col("spy_close") - F.round("spy_close", 2))
    return t.benchmark_series(spark, sf_dir).agg(F.count(F.lit(1)).alias("days"), F.max(gap).alias("worst"), F.avg(gap).alias("mean"))


# ---- views

@rule("v4_breakout_candidates", ("bars", "profiles"), f"select ticker, date, {r('close')} as close, sector from flagged join profiles using (ticker) where breakout_ok and is_active", FLAGGED)
def v4(spark, sf_dir):
    return flagged(spark, sf_dir).where("breakout_ok").join(t.profiles(spark, sf_dir).where("is_active"), "ticker").select("ticker", "date", "close", "sector")


@rule("v11_v15_session_display", ("bars",), f"select ticker, session_id, {r('min(entry)')} as entry_price, {r('arg_max(close, date)')} as last_price, {r('arg_max(close, date) / min(entry) - 1')} as pnl, max(date) < (select max(date) from bars) - 30 as stale from paths group by 1, 2", ON_TRADES)
def v15(spark, sf_dir):
    now = t.bars(spark, sf_dir).agg(F.max("date").alias("now"))  # one row
    g = paths(spark, sf_dir).groupBy("ticker", "session_id").agg(F.min("entry").alias("entry_price"), F.max_by("close", "date").alias("last_price"), F.max("date").alias("last"))
    return g.crossJoin(F.broadcast(now)).select("ticker", "session_id", "entry_price", "last_price", (F.col("last_price") / F.col("entry_price") - 1).alias("pnl"), (F.col("last") < F.date_sub("now", 30)).alias("stale"))


@rule("v16_dense_training", ("scores", "fundamentals", "shares"), f"""select b.ticker, b.date, {r('b.close * sh.shares_outstanding / 1e6')} as cap_millions, {r('b.close * sh.shares_outstanding / nullif(f.revenue, 0)')} as ps, {r('b.fwd')} as fwd
from (select *, lead(close, 5) {LINE} / close - 1 as fwd from scores) b asof left join shares sh on sh.ticker = b.ticker and sh.date <= b.date
asof left join (select * from fundamentals qualify row_number() over (partition by ticker, filing_date order by period_end desc) = 1) f on f.ticker = b.ticker and f.filing_date <= b.date where b.fwd is not null""")
def v16(spark, sf_dir):
    d = scored(spark, sf_dir).select("ticker", "date", "fwd").join(t.bars(spark, sf_dir).select("ticker", "date", "close"), ["ticker", "date"])
    d = j.asof(d, t.shares(spark, sf_dir).withColumnRenamed("date", "as_of"), "ticker", "date", "as_of", ["shares_outstanding"])
    f = j.latest_per_key(t.fundamentals(spark, sf_dir), ["ticker", "filing_date"], [F.desc("period_end")])
    d = j.asof(d, f, "ticker", "date", "filing_date", ["revenue"])
    cap = F.col("close") * F.col("shares_outstanding")
    return d.select("ticker", "date", (cap / 1e6).alias("cap_millions"), c.safe_ratio(cap, "revenue").alias("ps"), "fwd")


@rule("v19_activity_feed", ("bars",), "select ticker, entry_date as date, 'entry' as kind from sessions union all select ticker, exit_date, 'exit' from sessions where exit_date is not null", f"{FLAGGED},\n{SESSIONS}")
def v19(spark, sf_dir):
    s = sessions_of(spark, sf_dir)
    kinds = F.array(F.struct(F.col("entry_date").alias("date"), F.lit("entry").alias("kind")), F.struct(F.col("exit_date").alias("date"), F.lit("exit").alias("kind")))
    return s.select("ticker", F.inline(kinds)).where("date is not null")


@rule("v20_score_at_entry", ("scores",), f"select s.ticker, session_id, {r('x.score')} as score from sessions s asof left join scores x on x.ticker = s.ticker and x.date <= s.entry_date", f"{FLAGGED},\n{SESSIONS}")
def v20(spark, sf_dir):
    right = t.scores(spark, sf_dir).select("ticker", "date", "score")
    return j.asof(sessions_of(spark, sf_dir), right, "ticker", "entry_date", "date", ["score"]).select("ticker", "session_id", "score")


@rule("v22_rank_history", ("scores",), f"select date, ticker, k as rank, {r('score')} as score, lag(k) over (partition by ticker order by date) as previous from (select *, row_number() over (partition by date order by score desc, ticker) as k from scores) where k <= 2")
def v22(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))
    return t.scores(spark, sf_dir).withColumn("rank", k).where("rank <= 2").select("date", "ticker", "rank", "score", F.lag("rank").over(panel()).alias("previous"))


@rule("v27_indicator_board", ("macro",), f"select symbol, {r('arg_max(close, date)')} as latest, {r('arg_max(p, date)')} as prior, {r('100 * (arg_max(close, date) / arg_max(p, date) - 1)')} as change_pct from (select *, lag(close) over (partition by symbol order by date) as p from macro) where p is not null group by symbol")
def v27(spark, sf_dir):
    d = t.macro(spark, sf_dir).withColumn("p", F.lag("close").over(Window.partitionBy("symbol").orderBy("date"))).where("p is not null")
    g = d.groupBy("symbol").agg(F.max_by("close", "date").alias("latest"), F.max_by("p", "date").alias("prior"))
    return g.withColumn("change_pct", 100 * (F.col("latest") / F.col("prior") - 1))


@rule("v29_sector_heat", ("bars", "profiles"), f"select sector, date, {r('avg(x)')} as mean_return, count(*) as n from (select ticker, date, close / lag(close) {LINE} - 1 as x from bars) join profiles using (ticker) where x is not null group by 1, 2")
def v29(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date", c.change("close").alias("x")).where("x is not null")
    return d.join(t.profiles(spark, sf_dir).select("ticker", "sector"), "ticker").groupBy("sector", "date").agg(F.avg("x").alias("mean_return"), F.count(F.lit(1)).alias("n"))


@rule("v30_reports_by_quarter", ("fundamentals",), f"select period_end, count(*) as reports, {r('sum(revenue)')} as revenue from fundamentals group by 1")
def v30(spark, sf_dir):
    return t.fundamentals(spark, sf_dir).groupBy("period_end").agg(F.count(F.lit(1)).alias("reports"), F.sum("revenue").alias("revenue"))


@rule("e6_cap_at_report", ("bars", "fundamentals", "shares"), f"""select f.ticker, f.period_end, b.date, {r('b.close * s.shares_outstanding')} as cap from fundamentals f join bars b on b.ticker = f.ticker and abs(date_diff('day', f.period_end, b.date)) <= 7
asof left join shares s on s.ticker = b.ticker and s.date <= b.date qualify row_number() over (partition by f.ticker, f.period_end order by abs(date_diff('day', f.period_end, b.date)), b.date) = 1""")
def e6(spark, sf_dir):
    b = t.bars(spark, sf_dir).select("ticker", F.col("date").alias("price_date"), "close")
    d = j.nearest(t.fundamentals(spark, sf_dir).select("ticker", "period_end"), b, "ticker", "period_end", "price_date", ["price_date", "close"], 7).where("price_date is not null")
    d = j.asof(d, t.shares(spark, sf_dir).withColumnRenamed("date", "as_of"), "ticker", "price_date", "as_of", ["shares_outstanding"])
    return d.select("ticker", "period_end", F.col("price_date").alias("date"), (F.col("close") * F.col("shares_outstanding")).alias("cap"))


# ---- documents and definitions

@rule("k6_document_ingest", (), "select conv_id as run, max(turn) as version, arg_max(length(text), turn) as size from conversations where text is not null group by conv_id", "no as (select 1)")
def k6(spark, sf_dir):
    d = t.table(spark, sf_dir, "conversations", "conv_id", "turn", "text").where("text is not null")
    last = j.latest_per_key(d, ["conv_id"], [F.desc("turn")])
    return last.select(F.col("conv_id").alias("run"), F.col("turn").alias("version"), F.length("text").cast("long").alias("size"))


LABEL = '{"above":0.3,"days":20,"price":"close","target":"%s"}'


@rule("l7_definition_hash", ("bars", "profiles"), f"select distinct sector, sha256('{LABEL[:LABEL.index('%s')]}' || lower(sector) || '{LABEL[LABEL.index('%s') + 2:]}') as fingerprint from profiles")
def l7(spark, sf_dir):
    definition = F.struct(F.lit(0.3).alias("above"), F.lit(20).alias("days"), F.lit("close").alias("price"), F.lower("sector").alias("target"))  # keys in order: canonical
    return t.profiles(spark, sf_dir).select("sector", F.sha2(F.to_json(definition), 256).alias("fingerprint")).distinct()


@rule("x8_report_sections", (), "select conv_id, u.heading, trim(u.body, ' \n') as body from (select conv_id, string_agg(role || chr(10) || replace(coalesce(text, ''), chr(10), ' '), chr(10) order by turn) as report, list(struct_pack(heading := role, body := replace(coalesce(text, ''), chr(10), ' ')) order by turn) as us from conversations group by conv_id), unnest(us) as x(u)", "no as (select 1)")
def x8(spark, sf_dir):
    d = t.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    part = F.struct("turn", F.concat("role", F.lit("\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))).alias("part"))
    reports = d.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["part"]), "\n\n").alias("report"))
    return tx.sections(reports, "report", ["user", "assistant", "system"])


@rule("c25_batch_checks", ("bars",), "select date, count(*) filter (where close <= 0) as unpriced, count(*) filter (where volume = 0) * 2 > count(*) as mostly_idle, count(*) as n from bars group by date")
def c25(spark, sf_dir):
    return t.bars(spark, sf_dir).groupBy("date").agg(F.count_if(F.col("close") <= 0).alias("unpriced"), (F.count_if(F.col("volume") == 0) * 2 > F.count(F.lit(1))).alias("mostly_idle"), F.count(F.lit(1)).alias("n"))


@rule("c22_recent_filings", ("fundamentals",), f"select ticker, count(*) as n, {r('avg(filing_date - period_end)')} as mean_lag from fundamentals where filing_date >= (select max(filing_date) from fundamentals) - 365 group by ticker")
def c22(spark, sf_dir):
    f = t.fundamentals(spark, sf_dir)
    return f.crossJoin(F.broadcast(f.agg(F.max("filing_date").alias("now")))).where(F.col("filing_date") >= F.date_sub("now", 365)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.avg(F.date_diff("filing_date", "period_end")).alias("mean_lag"))  # one row


@rule("c21_coverage_deficit", ("bars", "scores"), "select b.date, count(*) as have, count(*) filter (where f.ticker is null) as deficit from bars b left join (select ticker, date from scores where score >= 0.2) f on f.ticker = b.ticker and f.date = b.date group by 1")
def c21(spark, sf_dir):
    d = t.bars(spark, sf_dir).select("ticker", "date").join(t.scores(spark, sf_dir).where("score >= 0.2").select("ticker", "date", F.lit(1).alias("one")), ["ticker", "date"], "left")
    return d.groupBy("date").agg(F.count(F.lit(1)).alias("have"), F.count_if(F.col("one").isNull()).alias("deficit"))
