"""Classification reports: scores by class and averaged, thresholds, calibration by width and by count, rankings compared, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators.series import exact_quantiles, running_sums
from barsmith.operators.writes import reread


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """s, pos, neg, n of each distinct score, with run_pos, run_neg, run_n from the highest score down to it. Written once, as
    the running sums read it three times and callers read it again."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(label).cast("double").alias("pos"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))
    return reread(running_sums(reread(counts, "score-counts"), "s", ("pos", "neg", "n"), descending=True), "score-sums")


def averaged_scores(confusion: DataFrame) -> DataFrame:
    """One row from (actual, predicted, n): accuracy, weighted_f1, macro_f1, micro_f1, n; classes are those that occur on
    either side, a class without any hit scores 0."""
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).cast("long").alias("hit")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    per = sides.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = 2 * F.col("hit") / (F.col("support") + F.col("said"))
    n, hits = F.sum("support"), F.sum("hit")
    return per.agg((hits / n).alias("accuracy"), (F.sum(f1 * F.col("support")) / n).alias("weighted_f1"), F.avg(f1).alias("macro_f1"), (2 * hits / (n + F.sum("said"))).alias("micro_f1"), n.alias("n"))


def thresholds(counts: DataFrame, floor: float) -> DataFrame:
    """mode, threshold, precision, recall, f1, n_signals, achievable over score_counts(): the lowest threshold whose precision
    reaches the floor (precision_min), the lowest with the highest F1 (f1_max), the highest with the largest difference
    of true and false positive rates (youden). Without positives or negatives recall, and rates, are 0."""
    total = counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))  # one row
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    d = counts.join(F.broadcast(total))
    d = d.withColumns({"precision": F.col("run_pos") / F.col("run_n"), "recall": safe(F.col("run_pos"), F.col("all_pos")), "f1": 2 * F.col("run_pos") / (F.col("run_n") + F.col("all_pos"))})
    d = d.withColumn("j", F.round(F.col("recall") - safe(F.col("run_neg"), F.col("all_neg")), 12)).withColumn("f", F.round("f1", 12))
    found = F.struct(F.col("s").alias("threshold"), "precision", "recall", "f1", F.col("run_n").cast("long").alias("n_signals"))
    best = d.agg(F.min_by(found, F.when(F.col("precision") >= floor, F.col("s"))).alias("precision_min"), F.max_by(found, F.struct("f", -F.col("s"))).alias("f1_max"), F.max_by(found, F.struct("j", "s")).alias("youden"))
    modes = ("precision_min", "f1_max", "youden")
    return best.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("x")) for m in modes])).alias("e")).select("e.mode", "e.x.*", F.col("e.x").isNotNull().alias("achievable"))


def quantiles(counts: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row, q: exact quantiles (straight lines between neighbours) of the scores of score_counts(), from running counts:
    no task holds the values."""
    last = counts.agg(F.sum("n").alias("all_n"))  # one row
    up = counts.join(F.broadcast(last)).withColumn("upto", F.col("all_n") - F.col("run_n") + F.col("n"))  # rows at or below s
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("s")))
    ends = []
    for i, p in enumerate(shares):
        place = (F.col("all_n") - 1) * p
        ends += [at(F.floor(place)).alias(f"a{i}"), at(F.ceil(place)).alias(f"b{i}"), F.first(place - F.floor(place)).alias(f"w{i}")]
    value = [F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"w{i}") for i in range(len(shares))]
    return up.agg(*ends).select(F.array(*value).alias("q"))


def calibration(df: DataFrame, score: str, label: str, bins: int, edges: DataFrame | None = None) -> DataFrame:
    """bin, lo, hi, n, mean_pred, mean_obs, gap: right-closed bins of equal width over [0, 1], all of them, empty ones with
    null means; or those between the edges (one row with an array q, inner edges), which can have equal counts."""
    spark = df.sparkSession
    inner = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    one = spark.range(1).select(inner.alias("q")) if edges is None else edges
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).join(F.broadcast(one))  # one row
    per = rows.withColumn("bin", F.size(F.filter("q", lambda e: F.col(score) > e)) + 1).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"), F.avg(label).alias("mean_obs"))
    every = one.select(F.posexplode(F.zip_with(F.concat(F.array(F.lit(0.0)), "q"), F.concat("q", F.array(F.lit(1.0))), lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))))).select((F.col("pos") + 1).alias("bin"), "col.lo", "col.hi")
    return every.join(per, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_pred", "mean_obs", F.abs(F.col("mean_pred") - F.col("mean_obs")).alias("gap"))


def calibration_errors(table: DataFrame) -> DataFrame:
    """One row over calibration(): ece (mean gap by rows), mce (largest gap), n; zeros without rows."""
    n = F.sum("n")
    return table.agg(F.coalesce(F.sum(F.col("n") * F.col("gap")) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("ece"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("mce"), n.alias("n"))


def ranked_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """date, ticker, left_rank, right_rank, rank_delta of tickers that both (date, ticker, score) have on a day: 1 is the
    highest score, ties go by ticker."""
    both = left.select("date", "ticker", F.col("score").alias("a")).join(right.select("date", "ticker", F.col("score").alias("b")), ["date", "ticker"])
    rank = lambda c: F.row_number().over(Window.partitionBy("date").orderBy(F.desc(c), "ticker"))
    return both.withColumns({"left_rank": rank("a"), "right_rank": rank("b")}).withColumn("rank_delta", F.col("right_rank") - F.col("left_rank")).select("date", "ticker", "a", "b", "left_rank", "right_rank", "rank_delta")


def ranking_days(pairs: DataFrame, k: int, tolerance: int = 0) -> DataFrame:
    """date, n_common, spearman (null where one side has one value), jaccard of the k best, disagreements (ranks more than
    the tolerance apart)."""
    top_a, top_b = F.col("left_rank") <= k, F.col("right_rank") <= k
    varied = (F.min("a") < F.max("a")) & (F.min("b") < F.max("b"))
    return pairs.groupBy("date").agg(
        F.count(F.lit(1)).alias("n_common"), F.when(varied, F.corr("left_rank", "right_rank")).alias("spearman"), (F.count_if(top_a & top_b) / F.count_if(top_a | top_b)).alias("jaccard"),
        F.count_if(F.abs("rank_delta") > tolerance).alias("disagreements"))


def ranking_summary(days: DataFrame) -> DataFrame:
    return days.agg(F.count(F.lit(1)).alias("n_dates"), F.sum("n_common").alias("n_rows"), F.avg("spearman").alias("mean_spearman"), F.avg("jaccard").alias("mean_jaccard"), F.sum("disagreements").alias("disagreements"))


def largest_disagreements(pairs: DataFrame, most: int, tolerance: int = 0) -> DataFrame:
    """The `most` rows whose ranks are farthest apart, later days and then tickers first among equals."""
    far = pairs.where(F.abs("rank_delta") > tolerance)
    return far.orderBy(F.desc(F.abs("rank_delta")), F.desc("date"), "ticker").limit(most).select("date", "ticker", "left_rank", "right_rank", "rank_delta")


def drift_report(df: DataFrame, features: Sequence[str], reference: Column, period: Column, bins: int = 10, least: int = 30, floor: float = 1e-6) -> DataFrame:
    """feature, period, n, psi, status of every period outside the reference against it: the population stability index over
    bins of equal reference counts, shares of at least `floor`; "stable" under 0.1, "moderate" under 0.25, else "major",
    and "thin" with fewer than `least` rows. df is written once, as it is read three times: edges come from exact_quantiles(),
    all features' in one row, so that no task holds the values of a feature."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], reference.alias("early"), period.alias("period")).where("early is not null")
    rows = reread(rows, "drift-rows")
    q = exact_quantiles(rows.where("early"), features, [k / bins for k in range(1, bins)])
    wide = rows.crossJoin(F.broadcast(q.select(*[F.col(c).alias(f"q_{i}") for i, c in enumerate(features)])))
    place = lambda i, c: sum(((F.col(c) > F.col(f"q_{i}")[k]).cast("int") for k in range(bins - 1)), F.lit(0))
    bins_of = F.array(*[F.struct(F.lit(i).alias("feature"), F.when(F.col(f"q_{i}").isNotNull(), place(i, c)).alias("bin")) for i, c in enumerate(features)])
    binned = wide.select(F.when(~F.col("early"), F.col("period")).alias("period"), F.inline(bins_of)).where("bin is not null")
    counts = binned.groupBy("feature", "period", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts = reread(counts.withColumn("feature", F.array(*map(F.lit, features))[F.col("feature")]), "drift-counts")
    edges = counts.where("period is null").select("feature").distinct()
    every = Window.partitionBy("feature", "period")
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("total", F.sum("n").over(every))
    base = shares.where("period is null").select("feature", "bin", F.col("share").alias("old"))
    now = shares.where("period is not null").select("feature", "period", "total").distinct().join(edges.select("feature"), "feature")
    grid = now.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    met = grid.join(shares.where("period is not null").select("feature", "period", "bin", "share"), ["feature", "period", "bin"], "left").join(base, ["feature", "bin"], "left")
    a, b = F.greatest(F.coalesce("old", F.lit(0.0)), F.lit(floor)), F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(floor))
    out = met.groupBy("feature", "period").agg(F.max("total").alias("n"), F.sum((b - a) * F.ln(b / a)).alias("psi"))
    status = F.when(F.col("n") < least, "thin").when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("major")
    return out.withColumn("status", status)


def _gates(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """df once for every threshold that its score reaches: partial aggregation takes in the copies before any shuffle."""
    reached = F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: x <= F.col(score))
    return df.withColumn("threshold", F.explode(reached))


def gate_rows(df: DataFrame, score: str, label: str, outcome: str, at: str, thresholds: Sequence[float], cuts: Sequence[float]) -> DataFrame:
    """A row for each threshold, of the rows with score >= threshold: n_pass, coverage, precision, lift (over the share of
    positives), recall, per_month, mean_outcome, median_outcome (of outcomes to four decimals, which bounds what a task
    holds) and p_over_<k>, the share of outcomes over the k-th cut.

    label: 0, 1 or null (counts in n_pass alone). Null scores pass nowhere. A threshold that nothing reaches has
    n_pass, coverage and per_month 0 and nulls; an empty table likewise, with a null coverage.
    """
    y, x = F.col(label), F.col(outcome)
    share = lambda cut: F.avg((x > cut).cast("double"))
    months = F.greatest(F.datediff(F.max(at), F.min(at)) / 30.4375, F.lit(1.0))
    passed = _gates(df, score, thresholds).groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_pass"), F.avg(y).alias("precision"), F.sum(y).alias("hits"), (F.count(F.lit(1)) / months).alias("per_month"), F.avg(x).alias("mean_outcome"),
        F.percentile(F.round(x, 4), F.lit(0.5)).alias("median_outcome"), *[share(cut).alias(f"p_over_{k}") for k, cut in enumerate(cuts, 1)])
    every = df.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg(y).alias("prevalence")).withColumn("threshold", F.explode(F.array(*[F.lit(float(v)) for v in thresholds])))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    return every.join(passed, "threshold", "left").select(
        "threshold", zero("n_pass").alias("n_pass"), (zero("n_pass") / F.nullif(F.col("n"), F.lit(0))).alias("coverage"), "precision", (F.col("precision") / F.nullif(F.col("prevalence"), F.lit(0.0))).alias("lift"),
        (F.col("hits") / F.nullif(F.col("positives"), F.lit(0))).alias("recall"), F.coalesce(F.col("per_month"), F.lit(0.0)).alias("per_month"), "mean_outcome", "median_outcome", *[f"p_over_{k}" for k in range(1, len(cuts) + 1)])


def gate_stability(df: DataFrame, score: str, label: str, at: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold, over the precisions of the calendar years in which labelled rows reach it: n_years, variance
    (sample), lowest, highest, range; with fewer than two years only n_years. Thresholds without any have no row."""
    years = _gates(df.where(F.col(label).isNotNull()), score, thresholds).groupBy("threshold", F.year(at).alias("year")).agg(F.avg(label).alias("precision"))
    d = years.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_years"), F.var_samp("precision").alias("variance"), F.min("precision").alias("lo"), F.max("precision").alias("hi"))
    some = lambda x: F.when(F.col("n_years") > 1, x)
    return d.select("threshold", "n_years", "variance", some(F.col("lo")).alias("lowest"), some(F.col("hi")).alias("highest"), some(F.col("hi") - F.col("lo")).alias("range"))
