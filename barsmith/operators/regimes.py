"""How well a daily score tells regimes apart: lag of its signals, separation, and a fitness of both.

The series have one row a day, so their windows need no key; everything wider is grouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators import stats as st

#: A score below this is a signal; days of lag that cost nothing, and the cost of each day beyond.
SIGNAL, FREE_LAG, LAG_COST = 40, 7, 0.01


def reaction_lags(days: DataFrame, regime: str = "BEAR", below: float = SIGNAL) -> DataFrame:
    """start_date, end_date, first_signal, detected, lag_days of each run of days of the regime.

    days: date, score, regime; one row a date. The signal is the run's first day with a score below the limit; a run
    without one counts with its whole length. Null scores are no signal; a null regime ends a run. An empty table,
    or one without the regime, gives no rows.
    """
    line = Window.orderBy("date")
    turn = ~F.col("regime").eqNullSafe(F.lag("regime").over(line))
    d = days.withColumn("turn", turn.cast("int")).withColumn("run", F.sum("turn").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.where(F.col("regime") == regime).groupBy("run").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.min(F.when(F.col("score") < below, F.col("date"))).alias("first_signal"))
    return runs.select("start_date", "end_date", "first_signal", F.col("first_signal").isNotNull().alias("detected"), F.datediff(F.coalesce("first_signal", "end_date"), "start_date").alias("lag_days"))


def score_by_regime(days: DataFrame) -> DataFrame:
    """regime, n_days, share, mean, std, min, max of the score; share of all days. Null regimes are one of their own."""
    d = days.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_days"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))
    return d.withColumn("share", F.col("n_days") / F.sum("n_days").over(Window.partitionBy()))  # one row a regime


def separation(days: DataFrame, low: str = "BEAR", high: str = "BULL") -> DataFrame:
    """One row: auc_low (scores of low days lie below all others), auc_high (those of high days above all others),
    cohens_d between the two (pooled by degrees of freedom), ks (greatest gap of their distributions)."""
    known = days.where("score is not null and regime is not null")
    auc = lambda regime, name: st.roc_auc(known.withColumn("label", (F.col("regime") == regime).cast("int")), "score", "label").select(F.col("auc").alias(name))
    two = known.where(F.col("regime").isin(low, high)).withColumn("label", (F.col("regime") == high).cast("int"))
    of = lambda f, v: f(F.when(F.col("label") == v, F.col("score")))
    free = lambda v: of(F.count, v) - 1
    pooled = F.sqrt((free(0) * of(F.var_samp, 0) + free(1) * of(F.var_samp, 1)) / F.nullif(free(0) + free(1), F.lit(0)))
    effect = two.agg(((of(F.avg, 1) - of(F.avg, 0)) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"))
    counts = st.running_sums(st.score_counts(two, "score", "label"), "s", ["pos", "neg"])
    totals = two.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    ks = counts.crossJoin(F.broadcast(totals)).agg(F.max(F.abs(F.col("run_pos") / F.nullif(F.col("p"), F.lit(0)) - F.col("run_neg") / F.nullif(F.col("n"), F.lit(0)))).alias("ks"))
    parts = [auc(low, "low").select((1 - F.col("low")).alias("auc_low")), auc(high, "auc_high"), effect, ks]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(F.broadcast(p))  # one row each
    return one


def fitness(days: DataFrame, low: str = "BEAR", high: str = "BULL") -> DataFrame:
    """One row: what separation() gives, n_periods, avg_lag, max_lag over the low runs, and fitness: 0.6 auc_low + 0.4 auc_high,
    less LAG_COST for each day that the average lag has beyond FREE_LAG. Without runs there is no lag to pay for."""
    lags = reaction_lags(days, low).agg(F.count(F.lit(1)).alias("n_periods"), F.avg("lag_days").alias("avg_lag"), F.max("lag_days").alias("max_lag"))
    cost = LAG_COST * F.greatest(F.coalesce(F.col("avg_lag"), F.lit(0.0)) - FREE_LAG, F.lit(0.0))
    return separation(days, low, high).crossJoin(F.broadcast(lags)).withColumn("fitness", 0.6 * F.col("auc_low") + 0.4 * F.col("auc_high") - cost)  # one row each
