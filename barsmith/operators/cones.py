"""Cones: the forward path of a strategy from every start day, and the distribution of what the paths give."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cone_cells(returns: DataFrame, horizon: int) -> DataFrame:
    """book, start_date, end_date, sharpe, total_return, max_drawdown (positive), calmar of the `horizon` days after every
    start day of a book (book, date, r) that has so many.

    Growth is a prefix product, so a path's return is one quotient. The deepest fall of a path comes from two pieces: days
    are cut into blocks as long as a path, so a path is the end of one block and the beginning of the next, and from
    the highest level, lowest level and deepest fall of both pieces follow those of the whole. No start day meets the
    days behind it.
    """
    line = Window.partitionBy("book").orderBy("date")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    d = returns.select("book", "date", "r", F.row_number().over(line).alias("p"), F.product(1 + F.col("r")).over(so_far).alias("g"))
    d = d.withColumn("piece", F.floor((F.col("p") - 1) / (horizon + 1)))
    inside = Window.partitionBy("book", "piece").orderBy("p")
    begun, left = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumns({"top0": F.max("g").over(begun), "low0": F.min("g").over(begun), "top1": F.max("g").over(left), "low1": F.min("g").over(left)})
    d = d.withColumns({"keep0": F.min(F.col("g") / F.col("top0")).over(begun), "keep1": F.min(F.col("low1") / F.col("g")).over(left)})
    path = line.rowsBetween(1, horizon)
    end = lambda c: F.lead(c, horizon).over(line)
    d = d.withColumns({"end_date": end("date"), "g1": end("g"), "other": end("piece"), "low_b": end("low0"), "keep_b": end("keep0"), "mean": F.avg("r").over(path), "std": F.stddev_samp("r").over(path)}).where("end_date is not null")
    across = F.when(F.col("other") > F.col("piece"), F.least("keep_b", F.col("low_b") / F.col("top1"))).otherwise(1.0)
    d = d.withColumns({"total_return": F.col("g1") / F.col("g") - 1, "max_drawdown": 1 - F.least("keep1", across), "sharpe": F.col("mean") / F.nullif("std", F.lit(0.0)) * 252**0.5})
    return d.select("book", F.col("date").alias("start_date"), "end_date", "sharpe", "total_return", "max_drawdown", (F.col("total_return") / F.nullif("max_drawdown", F.lit(0.0))).alias("calmar"))


def cone_summary(cells: DataFrame) -> DataFrame:
    """One row over cells that have a sharpe: n_cells, median, p25, p75 and floor of it, share of negative ones in percent,
    median calmar, median and worst max_drawdown."""
    q = lambda c, p, name: F.percentile(c, F.lit(p)).alias(name)  # noqa: E731  # a value a book and start day
    return cells.where("sharpe is not null").agg(
        F.count(F.lit(1)).alias("n_cells"), q("sharpe", 0.5, "median_sharpe"), q("sharpe", 0.25, "p25_sharpe"), q("sharpe", 0.75, "p75_sharpe"), F.min("sharpe").alias("floor_sharpe"),
        (F.avg((F.col("sharpe") < 0).cast("int")) * 100).alias("pct_negative"), q("calmar", 0.5, "median_calmar"), q("max_drawdown", 0.5, "median_max_drawdown"), F.max("max_drawdown").alias("worst_max_drawdown"))


def pooled_returns(returns: DataFrame, horizon: int) -> DataFrame:
    """date, r: the mean return of the day over all cells of all books that hold it (by how many of a book's cells do)."""
    line = Window.partitionBy("book").orderBy("date")
    d = returns.select("book", "date", "r", F.row_number().over(line).alias("p"), F.count(F.lit(1)).over(Window.partitionBy("book")).alias("n"))
    held = F.least(F.col("p") - 1, F.col("n") - horizon) - F.greatest(F.lit(1), F.col("p") - horizon) + 1
    d = d.withColumn("cells", held).where("cells > 0 and n > " + str(horizon))
    return d.groupBy("date").agg((F.sum(F.col("r") * F.col("cells")) / F.sum("cells")).alias("r"))


def alpha_beta(returns: DataFrame, bench: DataFrame, least: int = 20) -> DataFrame:
    """One row: alpha (of a year of 252 days), beta, days: least squares of r (date, r) on the benchmark's (date, b); null under
    `least` shared days or without variance."""
    both = returns.join(bench, "date").where(F.col("r").isNotNull() & F.col("b").isNotNull())
    beta = F.covar_pop("r", "b") / F.nullif(F.var_pop("b"), F.lit(0.0))
    d = both.agg(F.count(F.lit(1)).alias("days"), beta.alias("beta"), F.avg("r").alias("mr"), F.avg("b").alias("mb"))
    enough = F.col("days") >= least
    return d.select(F.when(enough, (F.col("mr") - F.col("beta") * F.col("mb")) * 252).alias("alpha"), F.when(enough, F.col("beta")).alias("beta"), "days")


def gates(row: DataFrame, rules: Mapping[str, tuple[str, float]]) -> DataFrame:
    """gate, value, threshold, passes: rules name a column of the one row with ">" or "<" and a threshold; null fails."""
    entries = [F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("threshold"), F.coalesce(F.col(c) > x if op == ">" else F.col(c) < x, F.lit(False)).alias("passes")) for c, (op, x) in rules.items()]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
