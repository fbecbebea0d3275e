"""Signals with state or memory: swing pivots, autocorrelation-robust t-statistics, cohort percentiles, applied models."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.columns import no_nan
from barsmith.operators.series import along


def swing_kinds(x: np.ndarray, reversal: np.ndarray) -> np.ndarray:
    """1 at bars that are swing highs of x, -1 at swing lows, 0 elsewhere: an extreme counts once x has come back
    from it by the reversal of the bar then reached; the last, unconfirmed extreme does not."""
    kinds = np.zeros(len(x), dtype=int)
    x, reversal = np.asarray(x).tolist(), np.asarray(reversal).tolist()  # numbers of Python: each is read by itself
    leg, best = (1 if len(x) > 1 and x[1] >= x[0] else -1), 0
    for i in range(1, len(x)):
        move = leg * (x[i] - x[best])
        if move > 0:
            best = i
        elif -move >= reversal[i]:
            kinds[best] = leg
            leg, best = -leg, i
    return kinds


def swings(df: DataFrame, x: str, reversal: str) -> DataFrame:
    """ticker, date, swing (see swing_kinds) of every row of df."""
    return with_swings(df.select("ticker", "date", x, reversal), x, reversal).select("ticker", "date", "swing")


def with_swings(df: DataFrame, x: str, reversal: str, dealt: bool = False) -> DataFrame:
    """df with swing (see swing_kinds). A ticker's history is in one task, a row a day. dealt: as for along()."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", swing int"

    def run(rows: pd.DataFrame, group: pd.Series) -> pd.DataFrame:
        values, back = rows[x].to_numpy(float), rows[reversal].to_numpy(float)
        ends = np.flatnonzero(np.diff(group.to_numpy())) + 1
        kinds = [swing_kinds(a, b) for a, b in zip(np.split(values, ends), np.split(back, ends), strict=True)]
        return rows.assign(swing=np.concatenate(kinds))

    return along(df, "ticker", "date", run, schema, dealt)


def newey_west_t(values: Column, lag: int = 5) -> Column:
    """t-statistic of the mean of an array without nulls, with Bartlett weights on the autocovariances up to lag; null for
    fewer than lag + 2 values or a variance that is not positive. In Arrow batches: as nested array functions every
    element would compute the mean again."""
    weights = np.array([1.0, *(2 * (1 - k / (lag + 1)) for k in range(1, lag + 1))])

    def one(x) -> float | None:
        if x is None or len(x) < lag + 2:
            return None
        e = np.asarray(x, float) - np.mean(x)
        spread = weights @ np.correlate(e, e, "full")[len(e) - 1 : len(e) + lag]  # n times the long-run variance
        return float(np.mean(x) * len(e) / np.sqrt(spread)) if spread > 0 else None

    @F.pandas_udf("double")
    def stat(batch: pd.Series) -> pd.Series:
        return batch.map(one).astype(float)

    return no_nan(stat(values))


def cohort_percentile(df: DataFrame, score: str, days: int) -> DataFrame:
    """df with percentile: the share of all scores of the last `days` dates of the table that are at most the row's own.

    Every row is sent to the dates whose window holds it (days copies of date and score), so a window is counted by
    itself. Dates are numbered by a join with the list of dates.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("date")  # a row a date
    numbers = df.select("date").distinct().withColumn("__n", F.row_number().over(line))
    counts = df.join(numbers, "date").groupBy("__n", F.col(score).alias("__s")).agg(F.count(F.lit(1)).alias("__c"))
    sent = counts.select(F.explode(F.sequence("__n", F.col("__n") + days - 1)).alias("__to"), "__n", "__s", "__c")
    up_to = Window.partitionBy("__to").orderBy("__s").rangeBetween(Window.unboundedPreceding, 0)
    ranked = sent.select("*", (F.sum("__c").over(up_to) / F.sum("__c").over(Window.partitionBy("__to"))).alias("percentile"))
    own = ranked.where("__n = __to").join(numbers, "__n").select("date", F.col("__s").alias(score), "percentile")
    return df.join(own, ["date", score], "left")


def linear_score(df: DataFrame, weights: Mapping[str, float], intercept: float) -> Column:
    """Probability of a supplied logistic model; features are found by name in any case, infinite values and
    NaN count as missing and give a null score. A feature that df does not have is an error."""
    have = {n.lower(): n for n in df.columns}
    missing = [n for n in weights if n.lower() not in have]
    if missing:
        raise KeyError(", ".join(missing))
    z = F.lit(float(intercept))
    for name, w in weights.items():
        z = z + w * no_nan(F.col(have[name.lower()]).cast("double"))
    return 1 / (1 + F.exp(-z))


def forbidden_names(names, words) -> list[str]:
    """The names that hold one of the words, in any case: columns that a model must not see."""
    return [n for n in names if any(w.lower() in n.lower() for w in words)]
