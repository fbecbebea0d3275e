"""Exact top-k by inner product: no-random-access aggregation over sorted lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.llm.common import written

#: Vectors whose lists are sorted together, and queries that are answered together over them.
VECTORS, QUERIES = 4096, 1024
#: Parts of a list that are read in one step.
STEPS = 16

PARTIAL = "query_id long, vec_id long, score long"


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (doubles): rows with an id and a vector without null or non-finite components."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", odd))


def dealt(df: DataFrame, name: str, blocks: int, *key: str) -> DataFrame:
    """df with a block from 0 to blocks - 1, by hash of the key; without a key rows are dealt one by one, so that
    repeated ids spread as well."""
    what = key or (F.monotonically_increasing_id(),)
    return df.withColumn(name, F.pmod(F.xxhash64(*what), F.lit(blocks)).cast("int"))


def sent_to(df: DataFrame, name: str, blocks: int) -> DataFrame:
    """Every row once for each of the blocks."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def best_of(partial: DataFrame, k: int) -> DataFrame:
    """The k best of each query over all blocks, ties to the smaller vec_id; blocks send k each at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nra(values: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | float = -np.inf, steps: int = STEPS) -> np.ndarray:
    """Rows that can be among each query's k best: a boolean (query, row) matrix.

    values: (rows, lists) whole numbers. Each list (a component) is sorted once and is read from its
    top for queries with a positive weight there and from its bottom for a negative one; nothing is
    looked up by row. After each step a row's lower bound takes the worst value of every list where it
    is still unseen, and its upper bound the list's last value read. A query stops when no more rows
    than it needs have an upper bound that reaches its k-th lower bound; rows below that are out. own
    marks a query's own row; floor is what each query's k-th best is known to reach by rows of other blocks.
    All numbers are whole and under 2**53, so doubles keep them exact.
    """
    floor = np.broadcast_to(np.asarray(floor, dtype=np.float64), len(queries))
    n, d = values.shape
    order = np.argsort(values, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], (n, d)), axis=0)
    lists = np.take_along_axis(values, order, axis=0)
    low, high = lists[0], lists[-1]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    kept = ~own
    live = np.flatnonzero(kept.sum(axis=1) > k)
    rows = np.arange(n)
    partial = np.zeros((len(queries), n))
    read = 0
    for step in range(1, steps + 1):
        if not len(live):
            break
        now = n * step // steps
        if now == read:
            continue
        u, w = up[live], down[live]
        rows = np.flatnonzero(kept[live].any(axis=0))
        p, v = place[rows], values[rows]
        top, bottom = (p >= n - now), (p < now)
        new_top, new_bottom = top & (p < n - read), bottom & (p >= read)
        seen = partial[np.ix_(live, rows)] + u @ np.where(new_top, v, 0.0).T + w @ np.where(new_bottom, v, 0.0).T
        partial[np.ix_(live, rows)] = seen
        unseen_top, unseen_bottom = (~top).T.astype(float), (~bottom).T.astype(float)
        worst = seen + (u * low) @ unseen_top + (w * high) @ unseen_bottom
        best = seen + (u * lists[n - now]) @ unseen_top + (w * lists[now - 1]) @ unseen_bottom
        inside = kept[np.ix_(live, rows)]
        worst[~inside] = -np.inf
        kth = np.partition(worst, len(rows) - k, axis=1)[:, len(rows) - k]
        inside &= best >= np.maximum(kth, floor[live])[:, None]
        kept[np.ix_(live, rows)] = inside
        live = live[inside.sum(axis=1) > k]
        read = now
    return kept


def _meet(k: int):
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            left = left.sort_values("vec_id", kind="stable")
            values, queries = np.floor(1024 * np.stack(left["vec"])), np.floor(1024 * np.stack(right["vec"]))
            ids, asks = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            own = asks[:, None] == ids[None, :]
            if np.abs(values).max() * np.abs(queries).max() * values.shape[1] < 2**53:
                kept = nra(values, queries, own, k, right["floor"].to_numpy())
            else:  # doubles would round: bounds are of no use, whole numbers of any size are
                kept = ~own
                values, queries = (np.vectorize(int, otypes=[object])(x) for x in (values, queries))
            for q in range(len(asks)):  # the rows left over get their final scores
                rows = np.flatnonzero(kept[q])
                score = values[rows] @ queries[q]
                if score.dtype == object and any(abs(x) >= 2**63 for x in score):
                    raise ArithmeticError(f"an inner product of vector {asks[q]} does not fit into 64 bits")
                score = score.astype(np.int64)
                best = np.lexsort((ids[rows], -score))[:k]
                out.append(pd.DataFrame({"query_id": asks[q], "vec_id": ids[rows[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return meet


def exact_top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest whole-number inner product.

    Components count as floor(1024 * x). A row with the query's vec_id is never its own answer; ties go
    to the smaller vec_id; with fewer than k other rows all are returned. Rows without an id, without a
    vector, with an empty one, or with null or non-finite components take no part, and a query meets
    only vectors of its own dimension. Repeated rows all count. Other columns are not read. Scores beyond 2**53
    are exact too (without early stops); a score that does not fit into 64 bits is an error.

    Each block of queries reads one block of rows first. The k-th score that a query finds there is a bound that
    travels with it to the other blocks, whose lists need not be read below it.
    """
    rows, asks = (usable(x, id_col, vec_col).withColumn("dim", F.size("vec")) for x in (df, queries))
    nv, nq = (max(1, -(-x.count() // per)) for x, per in ((rows, VECTORS), (asks, QUERIES)))
    # Both jobs below must see a row in one and the same block: the dealing follows how files are read, so it is written.
    left, right = sent_to(written(dealt(rows, "vb", nv), "top-k-rows"), "qb", nq), dealt(asks, "qb", nq, "vec_id")
    home = F.pmod(F.xxhash64("qb"), F.lit(nv)).cast("int")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ("dim", "vb", "qb")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_meet(k), PARTIAL)

    low = F.lit(float("-inf"))
    first = written(met(left.where(F.col("vb") == home), right.withColumn("vb", home).withColumn("floor", low)), "top-k-first")
    floors = best_of(first, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).alias("floor"))
    bounded = right.join(floors, right["vec_id"] == floors["query_id"], "left").select(*right.columns, F.coalesce("floor", low).alias("floor"))
    rest = met(left.where(F.col("vb") != home), sent_to(bounded, "vb", nv).where(F.col("vb") != home))
    return best_of(first.unionByName(rest), k)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of every 100th vector: edge cases as for exact_top_k()."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


OP7_SQL = """
with vecs as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from vecs q join vecs c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
