"""Write modes as functions of old and new rows (Parquet tables have no keys): first or last write wins, ranges, scopes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators.joins import latest_per_key, prefer


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with those new rows whose keys it does not have."""
    return prefer(old, new, keys)


def insert_or_replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new with those old rows whose keys it does not have."""
    return prefer(new, old, keys)


def upsert_by_source(old: DataFrame, new: DataFrame, keys: Sequence[str], source: str, trusted: str) -> DataFrame:
    """New rows replace old ones with the same keys, except those of the trusted source."""
    fixed = old.where(F.col(source) == trusted)
    return prefer(fixed, insert_or_replace(old, new, keys), keys)


def last_write(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last in load order."""
    return latest_per_key(rows, keys, order)


def replace_range(old: DataFrame, new: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    """Rows of [start, end] come from new, all others from old."""
    inside = (F.col(at) >= start) & (F.col(at) <= end)
    return old.where(~inside).unionByName(new.where(inside))


def replace_scope(old: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """Rows of one producer (column = value) come from new; the others stay."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def write_back(old: DataFrame, values: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """old with the named columns updated where values has the key and a value."""
    v = values.select(*keys, *[F.col(n).alias(f"__{n}") for n in names])
    joined = old.join(v, list(keys), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def relabel(df: DataFrame, key: str, at: str, old_name: str, new_name: str) -> DataFrame:
    """Rows of old_name become new_name's; where both have a time the old name's row stays."""
    moved = df.where(F.col(key) == old_name).withColumn(key, F.lit(new_name))
    rest = df.where(F.col(key) != old_name)
    return prefer(moved, rest, [key, at]).select(*df.columns)


def purge(df: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(bad.select(*keys).distinct(), list(keys), "left_anti")


def slice_window(df: DataFrame, at: str, days: int, keep: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The last `days` days of the table, and all rows of the keys in keep."""
    recent = df.crossJoin(F.broadcast(df.agg(F.max(at).alias("__m")))).where(F.col(at) >= F.date_sub("__m", days)).drop("__m")  # one row
    if keep is None:
        return recent
    return recent.unionByName(df.join(keep.select(key), key, "left_semi")).distinct()


def reread(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again; by: a folder for each value of the column."""
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("spark.checkpoint.dir names no shared folder")
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if by:
        df.repartition(by).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    schema = df.schema  # else Spark would guess the type of the folder's values
    return df.sparkSession.read.schema(schema).parquet(path)


def by_period(df: DataFrame, at: str, start: str, end: str, warmup_days: int, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """fn recomputed for [start, end] alone, from rows that reach warmup_days further back."""
    first = F.date_sub(F.lit(start).cast("date"), warmup_days)
    inside = (F.col(at) >= F.lit(start)) & (F.col(at) <= F.lit(end))
    return fn(df.where((F.col(at) >= first) & (F.col(at) <= F.lit(end)))).where(inside)
