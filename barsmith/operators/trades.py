"""Trade paths: entry selection, exits, capacity, costs, equity and its metrics."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_entries(scored: DataFrame, least: float, per_day: int) -> DataFrame:
    """Rows (ticker, date, score) at or above the floor: the best per_day of a day, then a ticker's first only."""
    best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))
    first = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return scored.where(F.col("score") >= least).withColumn("r", best).where(F.col("r") <= per_day).withColumn("f", first).where("f = 1").select("ticker", F.col("date").alias("entry_date"), "score")


def label_exits(entries: DataFrame, bars: DataFrame, stop: float, trail: float, days: int) -> DataFrame:
    """Each entry's exit within `days` calendar days: the first bar that hits the fixed stop, the trailing stop
    (below the highest close so far), or the last bar (timeout). Stops come before the trail on a bar; a bar
    that opens below its level fills at the open."""
    b = bars.select(F.col("ticker").alias("k"), "date", "open", "low", "close")
    held = entries.join(b, (F.col("k") == F.col("ticker")) & (F.col("date") >= F.col("entry_date")) & (F.col("date") <= F.date_add("entry_date", days)))
    line = Window.partitionBy("ticker", "entry_date").orderBy("date")
    held = held.withColumn("entry_price", F.first("close").over(line)).withColumn("peak", F.max("close").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    fixed, moving = F.col("entry_price") * (1 - stop), F.col("peak") * (1 - trail)
    after = F.col("date") > F.col("entry_date")
    reason = F.when(after & (F.col("low") <= fixed), "stop").when(after & (F.col("low") <= moving), "trail")
    fill = F.when(F.col("reason") == "stop", F.least("open", fixed)).when(F.col("reason") == "trail", F.least("open", moving)).otherwise(F.col("close"))
    held = held.withColumn("reason", reason).withColumn("fill", fill)
    hit = F.min(F.when(F.col("reason").isNotNull(), F.struct("date", "reason", "fill")))
    last = F.max(F.struct("date", F.lit("timeout").alias("reason"), F.col("close").alias("fill")))
    out = held.groupBy("ticker", "entry_date", "entry_price").agg(F.coalesce(hit, last).alias("x"))
    return out.select("ticker", "entry_date", "entry_price", F.col("x.date").alias("exit_date"), F.col("x.reason").alias("reason"), F.col("x.fill").alias("exit_price"))


def admit(trades: DataFrame, slots: int, priority: str | None = None) -> DataFrame:
    """Greedy admission per book: trades in order of entry (then of falling priority, then ticker) take a free slot
    until they exit. One book's trades are one group; books run in parallel."""

    def one(book: pd.DataFrame) -> pd.DataFrame:
        by = ["entry_date", *([priority] if priority else []), "ticker"]
        book = book.sort_values(by, ascending=[b != priority for b in by])
        busy: list = []
        taken = []
        for entry, exit_ in zip(book["entry_date"], book["exit_date"], strict=True):
            while busy and busy[0] <= entry:
                heapq.heappop(busy)
            taken.append(len(busy) < slots)
            if taken[-1]:
                heapq.heappush(busy, exit_)
        return book.assign(admitted=taken)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trades.schema)
    return trades.groupBy("book_id").applyInPandas(one, f"{schema}, admitted boolean")


def daily_returns(trades: DataFrame, bars: DataFrame, slots: int) -> DataFrame:
    """date, r: the book's return of each day, each held trade with the weight of one slot."""
    line = Window.partitionBy("ticker").orderBy("date")
    r = bars.select(F.col("ticker").alias("k"), "date", (F.col("close") / F.lag("close").over(line) - 1).alias("r"))
    held = trades.join(r, (F.col("k") == F.col("ticker")) & (F.col("date") > F.col("entry_date")) & (F.col("date") <= F.col("exit_date")))
    return held.groupBy("date").agg((F.sum("r") / slots).alias("r"))


def book_metrics(returns: DataFrame) -> DataFrame:
    """Sharpe, yearly return and volatility of a series of daily returns (date, r)."""
    mean, std = F.avg("r"), F.stddev_samp("r")
    return returns.agg((mean / F.nullif(std, F.lit(0.0)) * 252**0.5).alias("sharpe"), (mean * 252).alias("year_return"), (std * 252**0.5).alias("year_vol"), F.count(F.lit(1)).alias("days"))
