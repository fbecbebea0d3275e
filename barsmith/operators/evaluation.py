"""Evaluation of scores and views: isotonic calibration, separation of distributions, parity of two views, tree scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a calibration, or nodes of trees, that are sent to every task at most.
SENT = 1 << 20


# Isotonic calibration


def pooled(lo: Sequence[float], hi: Sequence[float], total: Sequence[float], n: Sequence[float]) -> list[list[float]]:
    """Blocks in order of their scores, pooled with their neighbours until means rise strictly: [lo, hi, total, n]."""
    out: list[list[float]] = []
    for block in zip(lo, hi, total, n, strict=True):
        a, b, t, w = block
        while out and out[-1][2] * w >= t * out[-1][3]:
            a, _, t0, w0 = out.pop()
            t, w = t + t0, w + w0
        out.append([a, b, t, w])
    return out


_BLOCKS = ["lo", "hi", "total", "n"]


def isotonic_fit(labelled: DataFrame, score: str, label: str, fan_in: int = 8) -> DataFrame:
    """lo, hi, value, n: the rising step function of the score that is nearest to the labels by squares.

    Scores are summed up first and dealt out by ranges; each range pools its adjacent violators, and stacks of fan_in
    neighbouring ranges are joined, level by level: pooling a row of pooled stacks gives what pooling all rows gives,
    and only blocks at the borders change. The last level holds the result and nothing else. Null scores and labels
    are left out.
    """
    rows = labelled.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    sums = rows.groupBy(F.col(score).cast("double").alias("lo")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, lo double, hi double, total double, n double"
    ordered = sums.withColumn("hi", F.col("lo")).repartitionByRange(parts, "lo").sortWithinPartitions("lo").withColumn("part", F.spark_partition_id()).select("part", *_BLOCKS)

    def local(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[list[float]] = []
        part = 0
        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            rows = [*stack, *batch[_BLOCKS].itertuples(index=False)]
            stack = pooled(*zip(*rows, strict=True)) if rows else []
        if stack:
            yield pd.DataFrame(stack, columns=_BLOCKS).assign(part=part)[["part", *_BLOCKS]]

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("lo")
        out = pd.DataFrame(pooled(*(group[c] for c in _BLOCKS)), columns=_BLOCKS)
        return out.assign(part=int(group["part"].iloc[0]) // fan_in)[["part", *_BLOCKS]]

    blocks = ordered.mapInPandas(local, schema)
    while parts > 1:
        blocks = blocks.groupBy(F.floor(F.col("part") / fan_in).alias("group")).applyInPandas(joined, schema)
        parts = -(-parts // fan_in)
    return blocks.select("lo", "hi", (F.col("total") / F.col("n")).alias("value"), F.col("n").cast("long").alias("n"))


def isotonic_transform(df: DataFrame, score: str, model: DataFrame, out: str = "calibrated") -> DataFrame:
    """df with the calibrated score: a block's value inside it, a straight line between blocks, the ends' values beyond.
    Null scores stay null. A model of over SENT blocks is an error: round its scores first."""
    blocks = model.orderBy("lo").limit(SENT + 1).toPandas()
    if len(blocks) > SENT:
        raise ValueError(f"the calibration has over {SENT} blocks")
    xs, ys = blocks[["lo", "hi"]].to_numpy().ravel(), np.repeat(blocks["value"].to_numpy(), 2)

    @F.pandas_udf("double")
    def value(s: pd.Series) -> pd.Series:
        return pd.Series(np.where(s.isna(), np.nan, np.interp(s, xs, ys))) if len(xs) else s * np.nan

    return df.withColumn(out, F.nanvl(value(F.col(score).cast("double")), F.lit(None).cast("double")))


# Separation of two groups, for many features at once


def separation(df: DataFrame, features: Sequence[str], positive: Column, parts: int = 32) -> DataFrame:
    """feature, n_pos, n_neg, mean_pos, mean_neg, ks, wasserstein of rows where positive holds or does not (null: left out).

    Features are unpivoted once and counted by value. Values are cut at approximate quantiles of their feature; sums of
    the parts before are added to the sums inside a part, so no task holds a feature. ks is the largest gap of
    the two distribution functions, wasserstein the integral of the gap.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]))
    long = df.where(positive.isNotNull()).select(pairs.alias("p"), positive.alias("pos")).select("p.feature", "p.x", "pos").where(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = long.groupBy("feature", "x").agg(F.count_if("pos").cast("double").alias("a"), F.count_if(~F.col("pos")).cast("double").alias("b"))
    cuts = counts.groupBy("feature").agg(F.percentile_approx("x", [k / parts for k in range(1, parts)], F.lit(1000)).alias("cuts"))  # a row a feature
    d = counts.join(F.broadcast(cuts), "feature").withColumn("part", F.size(F.filter("cuts", lambda c: F.col("x") > c))).drop("cuts")
    totals = d.groupBy("feature", "part").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum(F.col("x") * F.col("a")).alias("xa"), F.sum(F.col("x") * F.col("b")).alias("xb"), F.min("x").alias("first"))
    line = Window.partitionBy("feature").orderBy("part")  # parts of a feature
    every = Window.partitionBy("feature")
    before = lambda c: F.coalesce(F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    edges = totals.select("feature", "part", before("ta").alias("pa"), before("tb").alias("pb"), F.lead("first").over(line).alias("after"), *[F.sum(c).over(every).alias(n) for c, n in (("ta", "na"), ("tb", "nb"), ("xa", "sa"), ("xb", "sb"))])
    inside = Window.partitionBy("feature", "part").orderBy("x")
    d = d.withColumns({"ra": F.sum("a").over(inside), "rb": F.sum("b").over(inside), "next": F.lead("x").over(inside)}).join(F.broadcast(edges), ["feature", "part"])
    gap = F.abs((F.col("pa") + F.col("ra")) / F.col("na") - (F.col("pb") + F.col("rb")) / F.col("nb"))
    width = F.coalesce(F.coalesce("next", "after") - F.col("x"), F.lit(0.0))
    return d.groupBy("feature").agg(
        F.max("na").cast("long").alias("n_pos"), F.max("nb").cast("long").alias("n_neg"), (F.max("sa") / F.max("na")).alias("mean_pos"), (F.max("sb") / F.max("nb")).alias("mean_neg"),
        F.max(gap).alias("ks"), F.sum(gap * width).alias("wasserstein"))


# Parity of two views


def parity(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """One row a column: column_name, kind, compared, equal, null_mismatch, value_mismatch, max_diff; rows that one side lacks
    come as kinds "row": column_name "only_left" or "only_right" with their number in value_mismatch.

    Keys may repeat: rows of a key are matched by occurrence, in the order of their other columns, so that equal
    multisets match whatever their order. Columns of numbers ("number") are equal within tolerance, relative for values
    over 1; others ("text") if they are the same. Columns of one side only are "missing".
    """
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(left.dtypes)
    common = [c for c in left.columns if c in right.columns and c not in keys]
    is_number = {c: kinds[c].split("(")[0] in numeric | {"decimal"} for c in common}

    def numbered(df: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*common)) if common else F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
        values = F.struct(*[F.col(c).cast("double" if is_number[c] else "string").alias(c) for c in common], F.lit(1).alias("__there"))
        return df.withColumn("__nth", nth).select(*[F.col(k).alias(f"{side}_{k}") for k in keys], F.col("__nth").alias(f"{side}_nth"), values.alias(side))

    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in [*keys, "nth"]]
    both = numbered(left, "l").join(numbered(right, "r"), on, "full")
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    entries = [F.struct(F.lit(c).alias("column_name"), F.lit("number" if is_number[c] else "text").alias("kind"), *_compared(c, is_number[c], there, tolerance)) for c in common]
    row = lambda name, here: F.struct(F.lit(name).alias("column_name"), F.lit("row").alias("kind"), F.lit(0).alias("compared"), F.lit(0).alias("equal"), F.lit(0).alias("null_mismatch"), here.cast("int").alias("value_mismatch"), F.lit(None).cast("double").alias("max_diff"))
    entries += [row("only_left", F.col("r").isNull()), row("only_right", F.col("l").isNull())]
    flat = both.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    found = flat.groupBy("column_name", "kind").agg(*[F.sum(c).alias(c) for c in ("compared", "equal", "null_mismatch", "value_mismatch")], F.max("max_diff").alias("max_diff"))
    missing = [(c, "missing") for c in [*left.columns, *right.columns] if (c in left.columns) != (c in right.columns)]
    if not missing:
        return found
    zero = [F.lit(0).cast("long").alias(c) for c in ("compared", "equal", "null_mismatch", "value_mismatch")]
    return found.unionByName(left.sparkSession.createDataFrame(missing, "column_name string, kind string").select("column_name", "kind", *zero, F.lit(None).cast("double").alias("max_diff")))


def _compared(c: str, number: bool, there: Column, tolerance: float) -> list[Column]:
    a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
    nulls = a.isNull() != b.isNull()
    gap = F.abs(a - b) if number else F.lit(None).cast("double")
    same = (gap <= tolerance * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))) if number else a == b
    equal = there & ~nulls & (a.isNull() | same)
    one = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return [one(there).alias("compared"), one(equal).alias("equal"), one(there & nulls).alias("null_mismatch"), one(there & ~nulls & a.isNotNull() & ~same).alias("value_mismatch"), F.when(there, gap).alias("max_diff")]


# Tree scores


def tree_scores(df: DataFrame, trees: DataFrame, features: Sequence[str], base: float = 0.0, out: str = "score") -> DataFrame:
    """df with the summed leaf values of an ensemble: trees (tree, node, feature, threshold, left, right, value), node 0 the root.

    A row goes left if its feature is below the threshold, right if not or if it is null; a node without a feature is a
    leaf. Feature names are matched whatever their case; a feature that df lacks is an error, as is an ensemble of over
    SENT nodes. The nodes go to every task once; rows are scored in Arrow batches, one step of all trees at a time.
    """
    nodes = trees.select("tree", "node", "feature", "threshold", "left", "right", "value").orderBy("tree", "node").limit(SENT + 1).toPandas()
    if len(nodes) > SENT:
        raise ValueError(f"the ensemble has over {SENT} nodes")
    have = {c.lower(): c for c in features}
    lacking = sorted({f for f in nodes["feature"].dropna() if f.lower() not in have})
    if lacking:
        raise ValueError(f"features that the rows lack: {lacking}")
    place = {(t, k): i for i, (t, k) in enumerate(zip(nodes["tree"], nodes["node"], strict=True))}
    names = list(features)
    column = np.array([names.index(have[f.lower()]) if isinstance(f, str) else -1 for f in nodes["feature"]])
    limit, value = nodes["threshold"].to_numpy(dtype=float), nodes["value"].fillna(0.0).to_numpy(dtype=float)
    child = np.array([[place.get((t, a), 0), place.get((t, b), 0)] for t, a, b in zip(nodes["tree"], nodes["left"], nodes["right"], strict=True)]) if len(nodes) else np.zeros((0, 2), dtype=int)
    roots = np.array([place[t, 0] for t in sorted(set(nodes["tree"]))], dtype=int)

    @F.pandas_udf("double")
    def scored(x: pd.DataFrame) -> pd.Series:
        rows = x.to_numpy(dtype=float)
        at = np.repeat(roots[None, :], len(rows), axis=0)
        while at.size and (column[at] >= 0).any():
            c = column[at]
            right = ~(np.take_along_axis(rows, np.maximum(c, 0), axis=1) < limit[at])
            at = np.where(c >= 0, child[at, right.astype(int)], at)
        return pd.Series(base + (value[at].sum(axis=1) if at.size else np.zeros(len(rows))))

    return df.withColumn(out, scored(F.struct(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)])))
