"""Evaluation of scores against outcomes: information coefficients, deciles, lift, calibration, curves, drift, resampling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.columns import day_rank, safe_ratio
from barsmith.operators.series import running_sums


def daily_ic(df: DataFrame, score: str, outcome: str, least: int = 5) -> DataFrame:
    """date, ic, n: Spearman correlation of score and outcome within each day of at least `least` rows."""
    d = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull())
    d = d.select("date", day_rank(score).alias("a"), day_rank(outcome).alias("b"))
    spread = F.stddev_samp("a") * F.stddev_samp("b")
    return d.groupBy("date").agg((F.covar_samp("a", "b") / F.nullif(spread, F.lit(0.0))).alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame) -> DataFrame:
    mean, std, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.agg(mean.alias("mean_ic"), F.median("ic").alias("median_ic"), std.alias("std_ic"), (mean / F.nullif(std, F.lit(0.0)) * F.sqrt(n)).alias("t_stat"), n.alias("days"))


def day_deciles(df: DataFrame, score: str, outcome: str, n: int = 10) -> DataFrame:
    """bucket, n, mean, std of outcomes by ntile of score within the day."""
    tile = F.ntile(n).over(Window.partitionBy("date").orderBy(score, "ticker"))
    return df.withColumn("bucket", tile).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.stddev_samp(outcome).alias("std"))


def top_k_lift(df: DataFrame, score: str, outcome: str, ks: Sequence[int]) -> DataFrame:
    """k, lift: mean over days of (mean outcome of the k best) / (mean outcome of the day), days with at least k rows;
    null where no day has as many."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "ticker"))
    tops = [F.avg(F.when(F.col("r") <= k, F.col(outcome))).alias(f"k{k}") for k in ks]
    days = df.withColumn("r", rank).groupBy("date").agg(F.avg(outcome).alias("m"), F.count(F.lit(1)).alias("n"), *tops)
    long = days.select("m", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("top")) for k in ks])))
    return long.groupBy("k").agg(F.avg(F.when(F.col("n") >= F.col("k"), safe_ratio("top", "m"))).alias("lift"))


def precision_recall_at(df: DataFrame, score: str, label: str, k: int) -> DataFrame:
    """Mean over days with at least k rows and a positive: share of positives among the k best, share of positives caught."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "ticker"))
    days = df.withColumn("r", rank).groupBy("date").agg(F.sum(F.when(F.col("r") <= k, F.col(label)).otherwise(0)).alias("hit"), F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    return days.where((F.col("n") >= k) & (F.col("pos") > 0)).agg(F.avg(F.col("hit") / k).alias("precision"), F.avg(F.col("hit") / F.col("pos")).alias("recall"), F.count(F.lit(1)).alias("days"))


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with positives and negatives: what curves are built on (rows of one score meet here,
    so that running sums go over distinct scores)."""
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counting half."""
    c = running_sums(score_counts(df, score, label), "s", ["neg"]).withColumn("below", F.col("run_neg") - F.col("neg"))
    return c.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    c = running_sums(score_counts(df, score, label), "s", ["pos", "neg"], descending=True)
    return c.agg((F.sum(F.col("pos") * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))) / F.sum("pos")).alias("average_precision"))


def best_threshold(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, f1: the highest threshold with the greatest F1 of "score >= threshold"."""
    counts = score_counts(df, score, label)
    c = running_sums(counts, "s", ["pos", "neg"], descending=True).crossJoin(F.broadcast(counts.agg(F.sum("pos").alias("total"))))  # one row
    f1 = 2 * F.col("run_pos") / (F.col("run_pos") + F.col("run_neg") + F.col("total"))
    return c.select(F.struct(F.round(f1, 9).alias("f1"), F.col("s").alias("threshold")).alias("x")).agg(F.max("x").alias("x")).select("x.threshold", "x.f1")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame) -> DataFrame:
    """Per class precision, recall, F1, support from a confusion table (actual, predicted, n)."""
    hit = counts.where("actual = predicted").select(F.col("actual").alias("cls"), F.col("n").alias("tp"))
    said = counts.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("said"))
    is_ = counts.groupBy(F.col("actual").alias("cls")).agg(F.sum("n").alias("support"))
    d = is_.join(said, "cls", "full_outer").join(hit, "cls", "left").fillna(0, ["tp", "said", "support"])
    p, r = safe_ratio("tp", "said"), safe_ratio("tp", "support")
    return d.select("cls", p.alias("precision"), r.alias("recall"), (2 * F.col("tp") / F.nullif(F.col("said") + F.col("support"), F.lit(0))).alias("f1"), "support")


def probability_losses(df: DataFrame, p: str, label: str, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(label) * F.log(q) + (1 - F.col(label)) * F.log(1 - q))
    return df.agg(F.avg(F.pow(F.col(p) - F.col(label), F.lit(2.0))).alias("brier"), F.avg(loss).alias("log_loss"))


def calibration_bins(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """bin (right-closed, equal width), n, mean probability, observed rate, gap."""
    b = F.greatest(F.ceil(F.col(p) * bins), F.lit(1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(label).alias("rate")).withColumn("gap", F.abs(F.col("mean_p") - F.col("rate")))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def stability_index(reference: DataFrame, current: DataFrame, x: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """psi of x between two samples, by quantile edges of the reference."""
    qs = [k / bins for k in range(1, bins)]
    edges = reference.agg(F.percentile(x, F.array(*map(F.lit, qs))).alias("edges"))
    side = lambda d, name: d.crossJoin(F.broadcast(edges)).select(F.size(F.filter("edges", lambda e: F.col(x) > e)).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias(name))  # one row
    both = side(reference, "a").join(side(current, "b"), "bin", "full_outer").fillna(0, ["a", "b"])
    every = Window.partitionBy(F.lit(1))
    pa, pb = F.greatest(F.col("a") / F.sum("a").over(every), F.lit(eps)), F.greatest(F.col("b") / F.sum("b").over(every), F.lit(eps))
    return both.select(((pb - pa) * F.log(pb / pa)).alias("t")).agg(F.sum("t").alias("psi"))


def ks_distance(df: DataFrame, x: str, group: str) -> DataFrame:
    """Largest gap between the two groups' distribution functions (group 0 and 1)."""
    c = df.groupBy(F.col(x).alias("s")).agg(F.sum(group).cast("double").alias("one"), F.sum(1 - F.col(group)).cast("double").alias("zero"))
    total = c.agg(F.sum("one").alias("ones"), F.sum("zero").alias("zeros"))  # one row
    gap = F.abs(F.col("run_one") / F.col("ones") - F.col("run_zero") / F.col("zeros"))
    return running_sums(c, "s", ["one", "zero"]).crossJoin(F.broadcast(total)).agg(F.max(gap).alias("ks"))


def ranking_divergence(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """date, spearman, jaccard of two scorings (date, ticker, score): by day, over common tickers and the k best."""
    both = a.select("date", "ticker", F.col("score").alias("sa")).join(b.select("date", "ticker", F.col("score").alias("sb")), ["date", "ticker"])
    top = lambda s: F.row_number().over(Window.partitionBy("date").orderBy(F.desc(s), "ticker")) <= k
    d = both.select("date", "ticker", day_rank("sa").alias("ra"), day_rank("sb").alias("rb"), top("sa").alias("ta"), top("sb").alias("tb"))
    spread = F.stddev_samp("ra") * F.stddev_samp("rb")
    return d.groupBy("date").agg((F.covar_samp("ra", "rb") / F.nullif(spread, F.lit(0.0))).alias("spearman"), (F.count_if(F.col("ta") & F.col("tb")) / F.count_if(F.col("ta") | F.col("tb"))).alias("jaccard"))


def block_bootstrap(series: DataFrame, at: str, x: str, block_days: int, replicates: int, seed: int = 0) -> DataFrame:
    """replicate, mean: means of x over blocks of days drawn with replacement. x is additive, so each block is
    summed once and only block totals meet the replicates."""
    first = series.agg(F.min(at).alias("__a"))
    blocks = series.crossJoin(F.broadcast(first)).groupBy(F.floor(F.date_diff(at, "__a") / block_days).alias("block")).agg(F.sum(x).alias("total"), F.count(x).alias("n"))  # one row
    blocks = blocks.withColumn("place", F.row_number().over(Window.orderBy("block")) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    m = blocks.agg(F.max("m").alias("m"))
    draws = series.sparkSession.range(replicates).crossJoin(F.broadcast(m)).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(1), "m")).alias("k"), "m")
    draws = draws.select("replicate", F.pmod(F.xxhash64("replicate", "k", F.lit(seed)), F.col("m")).alias("place"))
    return draws.join(blocks.select("place", "total", "n"), "place").groupBy("replicate").agg((F.sum("total") / F.sum("n")).alias("mean"))


def permutation_null(df: DataFrame, score: str, outcome: str, replicates: int, seed: int = 0) -> DataFrame:
    """replicate, ic: the pooled rank correlation after outcomes are shuffled within their day. A day is one
    group; it sends the sums of each replicate, not its rows."""
    ranked = df.select("date", "ticker", day_rank(score).cast("double").alias("a"), day_rank(outcome).cast("double").alias("b"))

    def shuffled(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("ticker", kind="stable")
        a, b = day["a"].to_numpy(), day["b"].to_numpy()
        rng = np.random.default_rng([seed, pd.Timestamp(day["date"].iloc[0]).toordinal()])
        products = [float(a @ rng.permutation(b)) for _ in range(replicates)]
        return pd.DataFrame({"replicate": range(replicates), "n": float(len(a)), "sa": a.sum(), "sb": b.sum(), "saa": a @ a, "sbb": b @ b, "sab": products})

    sums = ranked.groupBy("date").applyInPandas(shuffled, "replicate long, n double, sa double, sb double, saa double, sbb double, sab double")
    s = {c: F.sum(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")}
    spread = F.sqrt(s["n"] * s["saa"] - s["sa"] * s["sa"]) * F.sqrt(s["n"] * s["sbb"] - s["sb"] * s["sb"])
    return sums.groupBy("replicate").agg(((s["n"] * s["sab"] - s["sa"] * s["sb"]) / F.nullif(spread, F.lit(0.0))).alias("ic"))


def walk_forward_folds(first_year: int, last_year: int, embargo_days: int) -> list[tuple[int, str, str, str]]:
    """(fold, train end, test start, test end): anchored yearly folds with an embargo before the test year."""
    import datetime as dt

    out = []
    for k, year in enumerate(range(first_year, last_year + 1)):
        start = dt.date(year, 1, 1)
        out.append((k, str(start - dt.timedelta(days=embargo_days)), str(start), str(dt.date(year + 1, 1, 1))))
    return out
