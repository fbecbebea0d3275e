"""Series operators that built-in windows cannot express: recursive averages, ladders of rules, running sums over values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _whole(batches: Iterable[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Rows that come by key, as frames that hold whole keys."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch[key].iloc[-1]
        cut = len(batch) - int((batch[key].isna() if pd.isna(last) else batch[key] == last).sum())
        if cut or (held and not _same(held[-1][key].iloc[-1], last)):
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _same(a, b) -> bool:
    return bool(pd.isna(a) and pd.isna(b) or a == b)


def along(df: DataFrame, key: str, at: str, fn: Callable[[pd.DataFrame, pd.Series], pd.DataFrame], schema: str, dealt: bool = False) -> DataFrame:
    """fn(rows, group) of the rows of whole keys, by key and at; group numbers the keys of the frame.

    Frames hold as many keys as a batch has, since a call of Python for every key costs more than most histories. dealt:
    df comes from windows of the key, or from a repartition by it, and is not exchanged again.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole(batches, key):
            k = rows[key]
            yield fn(rows, ((k != k.shift()) & ~(k.isna() & k.shift().isna())).cumsum())

    return (df if dealt else df.repartition(key)).sortWithinPartitions(key, at).mapInPandas(run, schema)


def ema(df: DataFrame, key: str, at: str, x: str, spans: Sequence[int], adjust: bool = False) -> DataFrame:
    """df with ema_<span> of x for every span: y = a x + (1 - a) y before, a = 2 / (span + 1); by key, in order of at.

    A key's history is in one task. Null x carries the average on. adjust: divide by the weights so far.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", ema_{s} double" for s in spans)

    def run(rows: pd.DataFrame, group: pd.Series) -> pd.DataFrame:
        line = rows[x].astype(float).groupby(group.to_numpy(), sort=False)
        return rows.assign(**{f"ema_{s}": line.ewm(span=s, adjust=adjust).mean().to_numpy() for s in spans})

    return along(df, key, at, run, schema)


def _means(x: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last n values of each line, NaN left out; place: a row's place in its line from 0. Values are added from
    the oldest on, as a window function adds them, so that both round alike; a frame's rows are added all at once."""
    known = ~np.isnan(x)
    value, total, count = np.where(known, x, 0.0), np.zeros(len(x)), np.zeros(len(x))
    for k in range(min(n - 1, int(place.max())), -1, -1):
        inside = place[k:] >= k
        total[k:] += np.where(inside, value[: len(x) - k], 0.0)
        count[k:] += inside & known[: len(x) - k]
    return np.divide(total, count, out=np.full(len(x), np.nan), where=count > 0)


def rolled(df: DataFrame, key: str, at: str, rolls: Mapping[str, tuple[str, str, int]], spans: Sequence[int] = (), x: str = "close", dealt: bool = False) -> DataFrame:
    """df with a column for each of rolls, name: (column, "mean", "max" or "min", n), over the last n rows of the key, this
    one included, nulls left out (n below 0: "max" or "min" over the next -n rows, this one not included); and with ema_<span> of x as ema() gives them; dealt: as for along(). A window function visits the n rows of a
    frame one by one for every row; here many rows take a step at once, and extremes visit a row once."""
    names = [*rolls, *[f"ema_{s}" for s in spans]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", `{n}` double" for n in names)

    def run(rows: pd.DataFrame, group: pd.Series) -> pd.DataFrame:
        values = rows[list({c for c, _, _ in rolls.values()} | {x})].astype(float)
        lines = values.groupby(group.to_numpy(), sort=False)
        place = lines.cumcount().to_numpy()

        def next_(c: str, how: str, n: int) -> np.ndarray:
            back = values[c].iloc[::-1].groupby(group.to_numpy()[::-1], sort=False).rolling(n, min_periods=1)
            return getattr(back, how)().droplevel(0).sort_index().groupby(group.to_numpy()).shift(-1).to_numpy()

        last = lambda c, how, n: _means(values[c].to_numpy(), place, n) if how == "mean" else getattr(lines[c].rolling(n, min_periods=1), how)().to_numpy()
        new = {name: last(c, how, n) if n > 0 else next_(c, how, -n) for name, (c, how, n) in rolls.items()}
        return rows.assign(**new, **{f"ema_{s}": lines[x].ewm(span=s, adjust=False).mean().to_numpy() for s in spans})

    return along(df, key, at, run, schema, dealt)


def ladder(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds (null does not)."""
    out = F.lit(default)
    for rule, label in reversed(rules):
        out = F.when(rule, F.lit(label)).otherwise(out)
    return out


def running_sums(df: DataFrame, at: str, names: Sequence[str], descending: bool = False, parts: int = 64) -> DataFrame:
    """df, of distinct non-null values at, with run_<name>: the sum of name over all rows up to this one.

    The values are cut at approximate quantiles into parts, summed within each, and the totals of the parts
    before are added: no task sees all rows, the driver only the cuts.
    """
    cuts = sorted(set(df.approxQuantile(at, [k / parts for k in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(at) > c)) if cuts else F.lit(0)
    df = df.withColumn("__part", part * (-1 if descending else 1))
    order = Window.partitionBy("__part").orderBy(F.desc(at) if descending else F.asc(at)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # of at most `parts` rows
    totals = df.groupBy("__part").agg(*[F.sum(n).alias(n) for n in names]).select("__part", *[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"__{n}") for n in names])
    inside = df.select("*", *[F.sum(n).over(order).alias(f"__in_{n}") for n in names])
    out = inside.join(F.broadcast(totals), "__part")
    return out.select(*[c for c in df.columns if c != "__part"], *[(F.col(f"__in_{n}") + F.col(f"__{n}")).alias(f"run_{n}") for n in names])


def exact_quantiles(df: DataFrame, names: Sequence[str], qs: Sequence[float], accuracy: int = 10000, margin: int = 5) -> DataFrame:
    """One row with an array for each column of names: its quantiles as F.percentile gives them (interpolated, nulls left out).

    Approximate quantiles on both sides of each wanted one bracket it. Values outside the brackets are only counted where
    they are, those inside, about 2 * margin / accuracy of the rows for each quantile, are counted by value and read in
    order: no task holds the distinct values of a column. Should a bracket miss its quantile, an error says so.
    """
    ends = [min(max(q + side * margin / accuracy, 0.0), 1.0) for q in qs for side in (-1, 1)]
    brackets = df.agg(*[F.percentile_approx(n, ends, accuracy).alias(f"__{n}") for n in names])  # one row
    one = lambda k, n: F.struct(F.lit(k).alias("c"), F.col(n).cast("double").alias("x"), F.col(f"__{n}").cast("array<double>").alias("ends"))
    long = df.select(*names).crossJoin(F.broadcast(brackets)).select(F.inline(F.array(*[one(k, n) for k, n in enumerate(names)]))).where("x is not null")
    step = lambda x: F.when(x, 1).otherwise(0)
    begun = sum((step(F.col("x") >= F.col("ends")[2 * i]) for i in range(len(qs))), F.lit(0))
    ended = sum((step(F.col("x") > F.col("ends")[2 * i + 1]) for i in range(len(qs))), F.lit(0))
    cells = long.select("c", (begun + ended).alias("cell"), F.when(begun > ended, F.col("x")).alias("v")).groupBy("c", "cell", "v").agg(F.count(F.lit(1)).alias("n"))
    line, whole = Window.partitionBy("c").orderBy("cell", "v"), Window.partitionBy("c")
    d = cells.withColumns({"upto": F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, 0)), "rows": F.sum("n").over(whole)})

    def at(place: Column) -> Column:
        here = (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
        lost = F.raise_error(F.lit("a bracket misses its quantile")).cast("double")
        return F.max(F.when(here, F.coalesce("v", lost)))

    out = {}
    for i, q in enumerate(qs):
        place = (F.col("rows") - 1) * q
        out |= {f"low{i}": at(F.floor(place)), f"high{i}": at(F.ceil(place)), f"part{i}": F.max(place - F.floor(place))}
    ends_of = d.groupBy("c").agg(*[v.alias(n) for n, v in out.items()])
    between = lambda i: F.col(f"low{i}") * (1 - F.col(f"part{i}")) + F.col(f"high{i}") * F.col(f"part{i}")
    values = F.array(*[F.when(F.col(f"low{i}") == F.col(f"high{i}"), F.col(f"low{i}")).otherwise(between(i)) for i in range(len(qs))])
    return ends_of.select("c", values.alias("values")).agg(*[F.max(F.when(F.col("c") == k, F.col("values"))).alias(n) for k, n in enumerate(names)])
