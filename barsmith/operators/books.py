"""Trade books: gated entries, exits that depend on the path, a shared pool of capital marked daily, and its metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a calendar cell by which spans find bars with an equi-join.
CELL = 64
POLICIES = ("sma", "nday", "atr_trail", "breakeven", "ratchet")


@dataclass(frozen=True)
class Rules:
    """Exit rules: shares of the entry price, multiples of the average true range, and counts of bars."""

    stop: float = 0.10
    sma: int = 50
    nday: int = 10
    atr: int = 14
    atr_multiple: float = 2.5
    breakeven_at: float = 0.10
    trail: float = 0.10
    most_bars: int = 252
    add_at: float = 0.05


def gated_entries(scored: DataFrame, least: float, per_day: int, warmup: int = 0, exposure: DataFrame | None = None) -> DataFrame:
    """ticker, entry_date, score: rows (ticker, date, score) at or above the floor, without the first `warmup` days that
    have any, without days whose exposure (date, weight) is not positive; the best per_day of a day (ties by ticker),
    and of those each ticker's first."""
    eligible = scored.where(F.col("score") >= least)
    if warmup:
        days = eligible.select("date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("date")))  # one row a day
        eligible = eligible.join(F.broadcast(days.where(F.col("nth") == warmup + 1).select(F.col("date").alias("begin"))), F.col("date") >= F.col("begin")).drop("begin")
    if exposure is not None:
        eligible = eligible.join(exposure.where("weight <= 0").select("date"), "date", "left_anti")
    best = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), "ticker"))
    chosen = eligible.withColumn("best", best).where(F.col("best") <= per_day)
    return chosen.groupBy("ticker").agg(F.min(F.struct("date", "score")).alias("x")).select("ticker", F.col("x.date").alias("entry_date"), F.col("x.score").alias("score"))


def priced(bars: DataFrame, rules: Rules) -> DataFrame:
    """Bars with their number, the average close of rules.sma and the average true range of rules.atr bars (fewer at first)."""
    line = Window.partitionBy("ticker").orderBy("date")
    before = F.lag("close").over(line)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    numbered = bars.select("ticker", "date", "open", "high", "low", "close", F.row_number().over(line).alias("n"), true_range.alias("true_range"))
    last = lambda k: line.rowsBetween(1 - k, 0)
    return numbered.select("ticker", "date", "open", "high", "low", "close", "n", F.avg("close").over(last(rules.sma)).alias("sma"), F.avg("true_range").over(last(rules.atr)).alias("atr"))


def held_bars(entries: DataFrame, numbered: DataFrame, most: int) -> DataFrame:
    """entries (at bars of their ticker) with entry_price and, numbered by bars_held, the next `most` bars. Bars and
    entries meet in cells of `most` bars, so an entry is compared with two cells and never with a ticker's history."""
    at = numbered.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), F.col("n").alias("n0"))
    e = entries.join(at, ["ticker", "entry_date"])
    e = e.withColumn("cell", F.explode(F.sequence(F.floor((F.col("n0") + 1) / most), F.floor((F.col("n0") + most) / most))))
    b = numbered.withColumn("cell", F.floor(F.col("n") / most))
    met = e.join(b, ["ticker", "cell"]).where((F.col("n") > F.col("n0")) & (F.col("n") <= F.col("n0") + most))
    return met.withColumn("bars_held", F.col("n") - F.col("n0")).drop("cell", "n0", "n")


def path_exits(entries: DataFrame, bars: DataFrame, rules: Rules, policies: Sequence[str] = POLICIES) -> DataFrame:
    """One row for each entry (ticker, entry_date, score) and policy: entry_price, exit_date, exit_price, reason,
    pnl_pct, holding_days and add_date (the first held bar whose high is add_at over the entry price, for a second
    tranche).

    A bar exits at the stop if its low is at or below the level, else by the policy's second condition, else after
    most_bars. Levels and conditions:
      sma        entry price less stop; a close below the average ("trend_break")
      nday       the same level; nday bars held ("nday_exit")
      atr_trail  the highest high since the entry less atr_multiple average true ranges
      breakeven  entry price less stop until a high is breakeven_at over it, then the higher of the entry price and the
                 highest high less trail
      ratchet    entry price less stop, raised by every bar before to its high less atr_multiple average true ranges
                 ("trail_stop" once it has risen)
    A stop fills at the level, or at the open if that is lower; other exits at the close. Trades that never exit are
    marked at their ticker's last close ("held_open"). Entries at no bar are dropped.
    """
    held = held_bars(entries, priced(bars, rules), rules.most_bars)
    line = Window.partitionBy("ticker", "entry_date").orderBy("bars_held")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    high, entry, initial = F.col("run_high"), F.col("entry_price"), F.col("entry_price") * (1 - rules.stop)
    reach = F.col("high") - rules.atr_multiple * F.col("atr")
    held = held.withColumns({"run_high": F.max("high").over(so_far), "raised": F.max(reach).over(before)})
    armed = F.when(high >= entry * (1 + rules.breakeven_at), F.greatest(entry, high * (1 - rules.trail))).otherwise(initial)
    never = F.lit(False)
    stop_loss = F.lit("stop_loss")
    plan: dict[str, tuple[Column, Column, Column, str]] = {  # level, reason of the stop, second condition, its reason
        "sma": (initial, stop_loss, F.col("close") < F.col("sma"), "trend_break"),
        "nday": (initial, stop_loss, F.col("bars_held") >= rules.nday, "nday_exit"),
        "atr_trail": (high - rules.atr_multiple * F.col("atr"), stop_loss, never, ""),
        "breakeven": (armed, stop_loss, never, ""),
        "ratchet": (F.greatest(initial, "raised"), F.when(F.col("raised") > initial, "trail_stop").otherwise("stop_loss"), never, ""),
    }
    held = held.withColumns({f"level_{p}": plan[p][0] for p in policies})

    def exit_of(p: str) -> Column:
        level = F.col(f"level_{p}")
        hit = F.col("low") <= level
        reason = F.when(hit, plan[p][1]).when(plan[p][2], plan[p][3]).when(F.col("bars_held") >= rules.most_bars, "max_hold")
        fill = F.when(hit, F.least(level, "open")).otherwise(F.col("close"))
        return F.min(F.when(reason.isNotNull(), F.struct("date", reason.alias("reason"), fill.alias("fill")))).alias(p)

    added = F.min(F.when(F.col("high") >= entry * (1 + rules.add_at), F.col("date"))).alias("add_date")
    first = held.groupBy("ticker", "entry_date").agg(*map(exit_of, policies), added)
    ends = bars.groupBy("ticker").agg(F.max(F.struct("date", "close")).alias("end"))
    opened = entries.join(bars.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price")), ["ticker", "entry_date"]).join(ends, "ticker")
    every = opened.join(first, ["ticker", "entry_date"], "left").withColumn("x", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.col(p).alias("exit")) for p in policies])))
    done = every.select(
        F.col("x.policy").alias("policy"), "ticker", "entry_date", "score", "entry_price", F.coalesce("x.exit.date", "end.date").alias("exit_date"),
        F.coalesce("x.exit.fill", "end.close").alias("exit_price"), F.coalesce("x.exit.reason", F.lit("held_open")).alias("reason"), "add_date")
    return done.withColumns({"pnl_pct": F.col("exit_price") / F.col("entry_price") - 1, "holding_days": F.date_diff("exit_date", "entry_date")})


def business_day(day: str | Column) -> Column:
    """The day, or the Monday after it at weekends."""
    d = F.col(day) if isinstance(day, str) else day
    return F.date_add(d, F.when(F.dayofweek(d) == 7, 2).when(F.dayofweek(d) == 1, 1).otherwise(0))


def equity_curve(trades: DataFrame, bars: DataFrame, size: float, starter: float | None = None, exposure: DataFrame | None = None) -> DataFrame:
    """date, open_trades, daily_return, growth (of a capital of 1) on every business day from the first entry to the last exit.

    A trade (ticker, entry_date, exit_date, add_date) earns its ticker's close-to-close returns on the business days
    after its entry up to its exit, at the weight `size`. Trades share the pool: where more are open than 1 / size, all
    weights of the day shrink in proportion. With starter, a trade has that part of its weight until its add_date.
    exposure (date, weight; lagged by the caller) scales days, each weight until the next one, 1 before the first.
    Bars of weekends are left out, and a day without a bar returns 0. The last windows run over one row a day.
    """
    span = trades.agg(F.min("entry_date").alias("first"), F.max("exit_date").alias("last"))
    grid = span.select(F.explode(F.sequence("first", "last")).alias("date")).where(F.dayofweek("date").between(2, 6))
    t = trades.select("ticker", business_day("entry_date").alias("begin"), business_day("exit_date").alias("end"), business_day("add_date").alias("add"))
    t = t.join(F.broadcast(span), F.col("end") <= F.col("last")).where("begin < end").drop("first", "last")  # one row

    inside = bars.where(F.dayofweek("date").between(2, 6)).join(F.broadcast(span), F.col("date").between(F.col("first"), F.col("last")))
    daily = F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1
    cell = lambda d: F.floor(F.unix_date(d) / CELL)
    returns = inside.select("ticker", "date", daily.alias("r")).where("r is not null").withColumn("cell", cell(F.col("date")))
    spans = t.withColumn("cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end")))))
    met = spans.join(returns, ["ticker", "cell"]).where("date > begin and date <= end")
    weight = F.lit(1.0) if starter is None else F.when(F.col("date") >= F.col("add"), 1.0).otherwise(starter)
    earned = met.groupBy("date").agg(F.sum(F.col("r") * weight).alias("earned"))

    moves = t.select(F.explode(F.array(F.struct(F.col("begin").alias("date"), F.lit(1).alias("move")), F.struct(F.col("end").alias("date"), F.lit(-1).alias("move")))).alias("x")).groupBy("x.date").agg(F.sum("x.move").alias("move"))
    line = Window.partitionBy(F.lit(0)).orderBy("date")
    slots = max(1, round(1 / size))
    days = grid.join(earned, "date", "left").join(moves, "date", "left").withColumn("open_trades", F.coalesce(F.sum("move").over(line), F.lit(0)))
    if exposure is None:
        days = days.withColumn("factor", F.lit(1.0))
    else:
        days = days.join(exposure.select("date", "weight"), "date", "left").withColumn("factor", F.coalesce(F.last("weight", ignorenulls=True).over(line), F.lit(1.0)))
    shared = F.when(F.col("open_trades") > slots, slots / F.col("open_trades")).otherwise(1.0)
    days = days.withColumn("daily_return", F.coalesce("earned", F.lit(0.0)) * size * shared * F.col("factor"))
    return days.select("date", "open_trades", "daily_return", F.product(1 + F.col("daily_return")).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("growth"))


def curve_metrics(curve: DataFrame) -> DataFrame:
    """One row over (date, growth): sharpe, ann_return, ann_vol, total_return, max_drawdown, calmar, days."""
    line = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    top = F.max("growth").over(line.rowsBetween(Window.unboundedPreceding, 0))
    c = curve.select("date", "growth", (F.col("growth") / F.lag("growth").over(line) - 1).alias("r"), (F.col("growth") / top - 1).alias("down"))
    first, last, n = F.min_by("growth", "date"), F.max_by("growth", "date"), F.count(F.lit(1))
    std = F.stddev_samp("r")
    year = F.pow(last / first, 252 / n) - 1
    return c.agg(
        (F.avg("r") / F.nullif(std, F.lit(0.0)) * 252**0.5).alias("sharpe"), year.alias("ann_return"), (std * 252**0.5).alias("ann_vol"), (last / first - 1).alias("total_return"),
        F.min("down").alias("max_drawdown"), (year / F.nullif(-F.min("down"), F.lit(0.0))).alias("calmar"), n.alias("days"))


def trade_metrics(trades: DataFrame, cost: float = 0.0) -> DataFrame:
    """One row: n_trades, win_rate and avg_pnl after the cost of both sides."""
    net = F.col("pnl_pct") - cost
    return trades.agg(F.count(F.lit(1)).alias("n_trades"), F.avg((net > 0).cast("int")).alias("win_rate"), F.avg(net).alias("avg_pnl"))
