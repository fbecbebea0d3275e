"""Score evaluation (T) over scores and forward returns, and over labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barsmith.functions.columns import panel
from barsmith.operators import stats as st
from barsmith.plans.base import LINE, query, with_views
from barsmith.plans.factors import rk
from barsmith.plans.features import rounded, rounded_sql
from barsmith.sources import tables as t

PANEL_SQL = f"p as (select ticker, date, score, fwd, cast(fwd > 0 as int) as up from (select *, lead(close, 5) {LINE} / close - 1 as fwd from scores) where fwd is not null)"


def scored(spark, sf_dir, *more, lines=False):
    d = t.scores(spark, sf_dir, lines, *more).withColumn("fwd", F.lead("close", 5).over(panel()) / F.col("close") - 1).where("fwd is not null")
    return d.select("ticker", "date", "score", "fwd", (F.col("fwd") > 0).cast("int").alias("up"), *(["close"] if more else []), *more)


def stat(name: str, sql: str, more: str = ""):
    """A query whose doubles are all rounded; the SQL is given with its own rounding."""

    def register(fn):
        @query(name, with_views("scores", more=", ".join(x for x in (PANEL_SQL, more) if x), sql=sql) if sql else None)
        def run(spark, sf_dir):
            d = fn(scored(spark, sf_dir))
            return d.select(*[rounded(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes])

        return run

    return register


r = rounded_sql
IC = f"""ranked as (select date, {rk('score')} as a, {rk('fwd')} as b from p),
ic as (select date, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) as ic, count(*) as n from ranked group by date having count(*) >= 5)"""
stat("t1_daily_ic", f"select date, {r('ic')} as ic, n from ic", IC)(lambda p: st.daily_ic(p, "score", "fwd"))
stat("t2_ic_summary", f"select {r('avg(ic)')} as mean_ic, {r('median(ic)')} as median_ic, {r('stddev_samp(ic)')} as std_ic, {r('avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(ic))')} as t_stat, count(ic) as days from ic", IC)(lambda p: st.ic_summary(st.daily_ic(p, "score", "fwd")))
stat("t7_day_deciles", f"select bucket, count(*) as n, {r('avg(fwd)')} as mean, {r('stddev_samp(fwd)')} as std from (select *, ntile(10) over (partition by date order by score, ticker) as bucket from p) group by bucket")(lambda p: st.day_deciles(p, "score", "fwd"))
LIFT = "rr as (select *, row_number() over (partition by date order by score desc, ticker) as r from p)"
stat("t9_top_k_lift", " union all ".join(f"select {k} as k, {r('avg(top / nullif(m, 0))')} as lift from (select date, avg(up) as m, avg(up) filter (where r <= {k}) as top from rr group by date having count(*) >= {k})" for k in (3, 10)), LIFT)(lambda p: st.top_k_lift(p, "score", "up", (3, 10)))
stat("t10_precision_recall_at_k", f"select {r('avg(hit / 5.0)')} as precision, {r('avg(hit * 1.0 / pos)')} as recall, count(*) as days from (select sum(case when r <= 5 then up else 0 end) as hit, sum(up) as pos from rr group by date having count(*) >= 5 and sum(up) > 0)", LIFT)(lambda p: st.precision_recall_at(p, "score", "up", 5))
stat("t13_confusion", "select up as actual, cast(score >= 0.5 as int) as predicted, count(*) as n from p group by 1, 2")(lambda p: st.confusion(p.withColumn("said", (F.col("score") >= 0.5).cast("int")), "up", "said"))
stat("t13_class_scores", f"select cls, {r('tp * 1.0 / nullif(said, 0)')} as precision, {r('tp * 1.0 / nullif(support, 0)')} as recall, {r('2.0 * tp / nullif(said + support, 0)')} as f1, support from (select cls, count(*) filter (where up = cls and s = cls) as tp, count(*) filter (where s = cls) as said, count(*) filter (where up = cls) as support from (select up, cast(score >= 0.5 as int) as s from p), (values (0), (1)) v(cls) group by cls)")(lambda p: st.class_scores(st.confusion(p.withColumn("said", (F.col("score") >= 0.5).cast("int")), "up", "said")))
CURVE = "cc as (select score as s, sum(up) * 1.0 as pos, sum(1 - up) * 1.0 as neg from p group by score)"
stat("t14_roc_auc", f"select {r('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))')} as auc from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as below from cc)", CURVE)(lambda p: st.roc_auc(p, "score", "up"))
stat("t15_average_precision", f"select {r('sum(pos * tp / n) / sum(pos)')} as average_precision from (select *, sum(pos) over (order by s desc rows between unbounded preceding and current row) as tp, sum(pos + neg) over (order by s desc rows between unbounded preceding and current row) as n from cc)", CURVE)(lambda p: st.average_precision(p, "score", "up"))
stat("t16_losses", f"select {r('avg(pow(score - up, 2))')} as brier, {r('avg(-(up * ln(q) + (1 - up) * ln(1 - q)))')} as log_loss from (select *, least(greatest(score, 1e-15), 1 - 1e-15) as q from p)")(lambda p: st.probability_losses(p, "score", "up"))
BINS = "bb as (select greatest(cast(ceil(score * 10) as int), 1) as bin, count(*) as n, avg(score) as mean_p, avg(up) as rate from p group by 1)"
stat("t17_calibration_bins", f"select bin, n, {r('mean_p')} as mean_p, {r('rate')} as rate, {r('abs(mean_p - rate)')} as gap from bb", BINS)(lambda p: st.calibration_bins(p, "score", "up"))
stat("t17_calibration_error", f"select {r('sum(n * abs(mean_p - rate)) / sum(n)')} as ece from bb", BINS)(lambda p: st.calibration_error(st.calibration_bins(p, "score", "up")))
stat("t21_best_threshold", f"select {r('s')} as threshold, {r('f1')} as f1 from (select s, round(2 * tp / (n + total), 9) as f1 from (select *, sum(pos) over (order by s desc rows between unbounded preceding and current row) as tp, sum(pos + neg) over (order by s desc rows between unbounded preceding and current row) as n, sum(pos) over () as total from cc)) order by round(f1, 9) desc, s desc limit 1", CURVE)(lambda p: st.best_threshold(p, "score", "up"))
stat("t22_probability_separation", f"select up, {r('avg(score)')} as mean_score from p group by up")(lambda p: p.groupBy("up").agg(F.avg("score").alias("mean_score")))
stat("t23_quarter_stability", f"select cast(date_trunc('quarter', date) as date) as quarter, {r('avg(up)')} as rate, count(*) as n from p group by 1 having count(*) >= 30")(lambda p: p.groupBy(F.trunc("date", "quarter").alias("quarter")).agg(F.avg("up").alias("rate"), F.count(F.lit(1)).alias("n")).where("n >= 30"))
stat("t12_threshold_sweep", f"select cast(th as double) as th, {r('avg(up) filter (where score >= th)')} as precision, {r('count(*) filter (where score >= th and up = 1) * 1.0 / sum(up)')} as recall, count(*) filter (where score >= th) as n from p, (values (0.25), (0.5), (0.75)) v(th) group by th")(
    lambda p: p.withColumn("th", F.explode(F.array(*map(F.lit, (0.25, 0.5, 0.75))))).groupBy("th").agg(F.avg(F.when(F.col("score") >= F.col("th"), F.col("up"))).alias("precision"), (F.count_if((F.col("score") >= F.col("th")) & (F.col("up") == 1)) / F.sum("up")).alias("recall"), F.count_if(F.col("score") >= F.col("th")).alias("n")))
stat("t25_stability_index", f"""select {r('sum((pb - pa) * ln(pb / pa))')} as psi from (select greatest(a * 1.0 / sum(a) over (), 1e-6) as pa, greatest(b * 1.0 / sum(b) over (), 1e-6) as pb from (
select len(list_filter(edges, lambda e: score > e)) as bin, count(*) filter (where date < date '1998-01-01') as a, count(*) filter (where date >= date '1998-01-01') as b from p, ed group by 1))""",
     "ed as (select quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from p where date < date '1998-01-01')")(lambda p: st.stability_index(p.where("date < '1998-01-01'"), p.where("date >= '1998-01-01'"), "score"))
stat("t37_ks_distance", f"select {r('max(abs(o / ot - z / zt))')} as ks from (select sum(pos) over (order by s rows between unbounded preceding and current row) as o, sum(pos) over () as ot, sum(neg) over (order by s rows between unbounded preceding and current row) as z, sum(neg) over () as zt from cc)", CURVE)(lambda p: st.ks_distance(p, "score", "up"))
stat("t3_ticker_correlation", f"select ticker, {r('corr(score, fwd)')} as c from p group by ticker")(lambda p: p.groupBy("ticker").agg(F.corr("score", "fwd").alias("c")))
stat("t11_pooled_top_k", f"select {r('avg(up)')} as precision, {r('avg(up) / (select avg(up) from p)')} as lift from (select up from p order by score desc, ticker, date limit 500)")(
    lambda p: p.orderBy(F.desc("score"), "ticker", "date").limit(500).agg(F.avg("up").alias("precision")).crossJoin(p.agg(F.avg("up").alias("base"))).select("precision", (F.col("precision") / F.col("base")).alias("lift")))
stat("t27_ranking_divergence", f"""select date, {r('covar_samp(ra, rb) / nullif(stddev_samp(ra) * stddev_samp(rb), 0)')} as spearman, {r('count(*) filter (where ta and tb) * 1.0 / count(*) filter (where ta or tb)')} as jaccard from (
select date, {rk('score')} as ra, {rk('sb')} as rb, row_number() over (partition by date order by score desc, ticker) <= 5 as ta, row_number() over (partition by date order by sb desc, ticker) <= 5 as tb from (select *, score * score - score as sb from p)) group by date""")(
    lambda p: st.ranking_divergence(p, p.withColumn("score", F.col("score") * F.col("score") - F.col("score")), 5))
stat("t33_chronological_split", "select case when pr < 0.6 then 'train' when pr < 0.8 then 'valid' else 'test' end as part, count(*) as n, min(date) as lo, max(date) as hi from (select *, (d - 1) * 1.0 / m as pr from (select *, dense_rank() over (order by date) as d from p), (select count(distinct date) as m from p)) group by 1")(
    lambda p: p.join(p.select("date").distinct().withColumn("d", F.row_number().over(Window.orderBy("date"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))), "date").withColumn("pr", (F.col("d") - 1) / F.col("m"))
    .groupBy(F.when(F.col("pr") < 0.6, "train").when(F.col("pr") < 0.8, "valid").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")))
FOLDS = st.walk_forward_folds(1997, 2000, 5)
stat("t32_walk_forward", " union all ".join(f"select {k} as fold, count(*) filter (where date < date '{a}') as n_train, count(*) filter (where date >= date '{b}' and date < date '{c}') as n_test from p" for k, a, b, c in FOLDS))(
    lambda p: p.join(F.broadcast(p.sparkSession.createDataFrame(FOLDS, "fold int, train_end string, test_start string, test_end string")), F.lit(True)).groupBy("fold").agg(  # four rows
        F.count_if(F.col("date") < F.to_date("train_end")).alias("n_train"), F.count_if((F.col("date") >= F.to_date("test_start")) & (F.col("date") < F.to_date("test_end"))).alias("n_test")))
stat("t28_block_bootstrap", "")(lambda p: st.block_bootstrap(p, "date", "fwd", 60, 200))
stat("t29_permutation_null", "")(lambda p: st.permutation_null(p, "score", "fwd", 10))
