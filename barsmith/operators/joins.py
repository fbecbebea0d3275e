"""Joins along time: as-of, nearest, interval, next event, gap filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, take: Sequence[str], forward: bool = False) -> DataFrame:
    """left with, for each row, the columns `take` of the last right row at or before it (forward: the first at
    or after it); null if there is none.

    Both sides are put in one timeline per key and the last right row is carried along: one shuffle by
    key, no range join. Of right rows with the same key and time the one with the greatest values counts.
    """
    right = right.select(F.col(key).alias("__k"), F.col(right_on).alias("__t"), F.struct(*[F.col(c) for c in take]).alias("__r"))
    right = right.groupBy("__k", "__t").agg(F.max("__r").alias("__r"))
    rows = left.select(F.col(key).alias("__k"), F.col(left_on).alias("__t"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    line = rows.unionByName(right, allowMissingColumns=True)
    side = F.col("__l").isNotNull().cast("int")
    order = [F.desc("__t"), side] if forward else ["__t", side]
    w = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    return line.select("__l.*", *[F.col(f"__r.{c}").alias(c) for c in take])


def asof_few(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, take: Sequence[str]) -> DataFrame:
    """As asof(), for a right side with few rows a key: they come to each left row as one list. A left side that is
    partitioned by key (after a window of the key, or a repartition by it) is not exchanged. Null keys and times match nothing."""
    at = F.struct(F.col(right_on).alias("t"), F.struct(*[F.col(c) for c in take]).alias("r"))
    lists = right.where(F.col(right_on).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.collect_list(at).alias("__f"))
    joined = left.join(lists.hint("merge"), left[key] == F.col("__k"), "left")
    last = F.array_max(F.filter("__f", lambda f: f["t"] <= F.col(left_on)))["r"]
    return joined.select(*left.columns, last.alias("__r")).select(*left.columns, *[F.col(f"__r.{c}").alias(c) for c in take])


def interval_join(left: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, how: str = "inner", closed: bool = False) -> DataFrame:
    """left rows with the spans of their key that hold them: [start, end), or [start, end] if closed; a null end
    is open. Equi-join on the key with the range as its other condition."""
    upper = left[at] <= spans[end] if closed else left[at] < spans[end]
    on = (left[key] == spans[key]) & (left[at] >= spans[start]) & (spans[end].isNull() | upper)
    return left.join(spans, on, how).drop(spans[key])


def validity(log: DataFrame, key: str, since: str) -> DataFrame:
    """An event log as half-open spans: valid_to is the next event of the key, null for the last."""
    return log.withColumn("valid_to", F.lead(since).over(Window.partitionBy(key).orderBy(since)))


def nearest(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, take: Sequence[str], days: int) -> DataFrame:
    """left with the right row closest in time within `days`; of two equally close ones the earlier.

    Two as-of joins (backward, forward) instead of a range join."""
    names = list(left.columns)
    r = right.select(key, F.col(right_on).alias("__at"), *take)
    back = asof(left, r, key, left_on, "__at", ["__at", *take])
    back = back.select(*names, F.struct("__at", *take).alias("__b"))
    both = asof(back, r, key, left_on, "__at", ["__at", *take], forward=True).select(*names, "__b", F.struct("__at", *take).alias("__f"))
    gap = lambda s: F.abs(F.date_diff(F.col(f"{s}.__at"), F.col(left_on)))
    gb, gf = F.coalesce(gap("__b"), F.lit(1 << 30)), F.coalesce(gap("__f"), F.lit(1 << 30))
    best = F.when(F.least(gb, gf) > days, None).when(gb <= gf, F.col("__b")).otherwise(F.col("__f"))
    return both.withColumn("__n", best).select(*names, *[F.col(f"__n.{c}").alias(c) for c in take])


def next_event(left: DataFrame, events: DataFrame, key: str, at: str, event_at: str, days: int) -> DataFrame:
    """left with next_date, the key's first event after it within `days`, and days_to_event."""
    e = events.select(key, F.date_sub(event_at, 1).alias("__before"), F.col(event_at).alias("next_date"))
    found = asof(left, e, key, at, "__before", ["next_date"], forward=True)
    near = F.date_diff("next_date", at) <= days
    return found.withColumn("next_date", F.when(near, F.col("next_date"))).withColumn("days_to_event", F.date_diff("next_date", at))


def fill_calendar(series: DataFrame, key: str, at: str, values: Sequence[str], calendar: DataFrame) -> DataFrame:
    """Every key on every calendar day from its first row on, values carried forward. The calendar travels as one array of
    its days, of which each key takes those from its first row on."""
    spans = series.groupBy(key).agg(F.min(at).alias("__lo"))
    days = calendar.agg(F.collect_set(at).alias("__days"))  # one row, an entry a day
    grid = spans.crossJoin(F.broadcast(days)).select(key, F.explode(F.filter("__days", lambda d: d >= F.col("__lo"))).alias(at))
    joined = grid.join(series.select(key, at, *values), [key, at], "left")
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return joined.select(key, at, *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])


def outer_fill(frames: Sequence[DataFrame], at: str) -> DataFrame:
    """Full outer join of series on their time, values carried forward (for short series without a key)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, at, "full_outer")
    w = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return out.select(at, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in out.columns if c != at])


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union in which rows of the first frame hide those of the second with the same keys."""
    return first.unionByName(second.join(first.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def attach_flags(df: DataFrame, flags: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Boolean columns joined on; missing ones are false, old ones of the same names replaced."""
    kept = df.select(*[c for c in df.columns if c not in names])
    joined = kept.join(flags.select(*keys, *names), list(keys), "left")
    return joined.select(*kept.columns, *[F.coalesce(n, F.lit(False)).alias(n) for n in names])


def align_versions(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of both versions side by side, columns with suffixes _a and _b; missing on one side is null."""
    ra = a.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values])
    rb = b.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values])
    return ra.join(rb, list(keys), "full_outer")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
