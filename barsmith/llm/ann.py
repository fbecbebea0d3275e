"""Maximum inner product search: score-aware anisotropic quantisation, four-bit table scans with bounds, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import written
from barsmith.llm.topk import best_of, dealt, sent_to, usable

#: A code has four bits.
CENTROIDS = 16
#: Components of one code.
SUB = 2
#: Rows that the codebooks are trained on at most (those with the smallest hash of their id).
TRAIN = 8192
#: Codes of a block, queries of a block.
VECTORS, QUERIES = 16384, 4096
#: Rows of a block that are reranked first for a query, as a multiple of k.
RERANK = 16

FOUND = "query_id long, vec_id long, score double"


@dataclass
class Codebooks:
    """centres: (codes, CENTROIDS, SUB); weight: how much dearer parallel residuals are."""

    centres: np.ndarray
    weight: float

    def _parts(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centres)
        padded = np.zeros((len(x), m * SUB))
        padded[:, :x.shape[1]] = x
        return padded.reshape(len(x), m, SUB)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, codes) by coordinate descent on |r|^2 + (weight - 1) (r . x/|x|)^2, r = x - its code."""
        parts = self._parts(x)
        unit = self._parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
        m = len(self.centres)
        codes = np.empty((len(x), m), dtype=np.uint8)
        along = np.empty((len(x), m))  # each code's share of r . x/|x|
        for j in range(m):
            codes[:, j] = ((parts[:, j, None] - self.centres[j]) ** 2).sum(-1).argmin(1)
            along[:, j] = ((parts[:, j] - self.centres[j][codes[:, j]]) * unit[:, j]).sum(-1)
        total = along.sum(1)
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[:, j]
                gap = parts[:, j, None] - self.centres[j]
                dot = (gap * unit[:, j, None]).sum(-1)
                cost = (gap**2).sum(-1) + (self.weight - 1) * (rest[:, None] + dot) ** 2
                codes[:, j] = cost.argmin(1)
                along[:, j] = np.take_along_axis(dot, codes[:, j, None].astype(np.intp), 1)[:, 0]
                total = rest + along[:, j]
        return codes


    def decode(self, codes: np.ndarray, dim: int) -> np.ndarray:
        """What the codes stand for: (rows, dim)."""
        return np.concatenate([self.centres[j][codes[:, j]] for j in range(len(self.centres))], axis=1)[:, :dim]


def length(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, of any size of components."""
    top = np.maximum(np.abs(x).max(axis=1), 1e-300)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def anisotropic_weight(dim: int, threshold: float = 0.2) -> float:
    """Ratio of the parallel to the orthogonal penalty for inner products above threshold (unit vectors)."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def train(x: np.ndarray, rounds: int = 8, seed: int = 7) -> Codebooks:
    """Codebooks that minimise the score-aware loss: given the codes, each centre solves a SUB x SUB system."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    m = -(-dim // SUB)
    start = x[rng.permutation(len(x))[: CENTROIDS]]
    start = np.concatenate([start, rng.normal(scale=max(float(x.std()), 1e-6), size=(CENTROIDS - len(start), dim))])
    books = Codebooks(np.zeros((m, CENTROIDS, SUB)), anisotropic_weight(dim))
    books.centres = books._parts(start).transpose(1, 0, 2).copy()
    parts = books._parts(x)
    unit = books._parts(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30))
    extra = books.weight - 1
    for _ in range(rounds):
        codes = books.encode(x, sweeps=1)
        along = np.stack([((parts[:, j] - books.centres[j][codes[:, j]]) * unit[:, j]).sum(-1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            u, p, c = unit[:, j], parts[:, j], codes[:, j]
            for k in range(CENTROIDS):
                own = c == k
                if own.any():
                    uo, po = u[own], p[own]
                    left = own.sum() * np.eye(SUB) + extra * uo.T @ uo
                    right = po.sum(0) + extra * ((rest[own] + (po * uo).sum(1))[:, None] * uo).sum(0)
                    books.centres[j, k] = np.linalg.solve(left, right)
            along[:, j] = ((p - books.centres[j][c]) * u).sum(-1)
            total = rest + along[:, j]
    return books


def build_index(rows: DataFrame, train_rows: int = TRAIN) -> tuple[DataFrame, dict[int, Codebooks]]:
    """Every row with its packed codes (two codes a byte), its slack, and the codebooks of each dimension.

    slack times a query's length is what the tables' score of the row can be wrong by: the length of what the codes
    leave out, and the rounding of tables and sums to single precision.

    Only training looks at a bounded sample: the train_rows rows whose ids have the smallest hashes. A dimension
    that the sample has missed takes the centres of the others' parts, so that all rows have codes.
    """
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(train_rows).toPandas()
    by_dim: dict[int, list] = {}
    for v in sample["vec"]:
        by_dim.setdefault(len(v), []).append(np.asarray(v, dtype=np.float64))
    books = {d: train(np.stack(v)) for d, v in by_dim.items()}

    def encode(batches):
        for batch in batches:
            codes, slack = np.empty(len(batch), dtype=object), np.empty(len(batch))
            sizes = batch["vec"].map(len).to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                book, x = book_of(books, int(d)), np.stack(batch["vec"].iloc[at]).astype(np.float64)
                c = book.encode(x)
                told = book.decode(c, int(d))
                slack[at] = length(x - told) * (1 + 1e-9) + (len(book.centres) + 2) * 1.2e-7 * length(told)
                c = np.pad(c, ((0, 0), (0, c.shape[1] % 2)))
                packed = (c[:, 0::2] << 4) | c[:, 1::2]
                for i, row in zip(at, packed, strict=True):
                    codes[i] = row.tobytes()
            yield batch.assign(codes=codes, slack=slack)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", codes binary, slack double"
    return rows.mapInPandas(encode, schema), books


def book_of(books: dict[int, Codebooks], dim: int) -> Codebooks:
    """The codebooks of a dimension; where there are none, one of all parts of the most trained dimension, spread over its parts."""
    if dim in books:
        return books[dim]
    other = books[max(books)]
    pooled = np.take(other.centres.reshape(-1, SUB), np.linspace(0, len(other.centres) * CENTROIDS - 1, CENTROIDS).astype(int), axis=0)
    return Codebooks(np.broadcast_to(pooled, (-(-dim // SUB), CENTROIDS, SUB)).copy(), anisotropic_weight(dim))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one query, added up in order of the components: equal rows have equal ones."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += x[:, j] * q[j]
    return out


def _scan(books: dict[int, Codebooks], k: int, first: int):
    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(left) and len(right):
            x, q = (np.stack(side["vec"]).astype(np.float64) for side in (left, right))
            ids, asks, slack = left["vec_id"].to_numpy(), right["vec_id"].to_numpy(), left["slack"].to_numpy()
            book, n = book_of(books, q.shape[1]), len(left)
            packed = np.frombuffer(b"".join(left["codes"]), dtype=np.uint8).reshape(n, -1)
            codes = np.empty((n, 2 * packed.shape[1]), dtype=np.uint8)
            codes[:, 0::2], codes[:, 1::2] = packed >> 4, packed & 15
            parts, top, sizes = book._parts(q), min(n, max(first, k)), length(q)
            blur = 1e-15 * (q.shape[1] + 8) * sizes * length(x).max()  # what products may differ by with the order of sums
            for at in range(0, len(asks), 64):
                part = slice(at, at + 64)
                near = np.zeros((n, len(asks[part])), dtype=np.float32)
                for j in range(len(book.centres)):  # a table of 16 scores for each code and query
                    near += (book.centres[j] @ parts[part, j].T).astype(np.float32)[codes[:, j]]
                own = ids == asks[part, None]
                near = np.where(own, -np.inf, near.T.astype(np.float64))
                ahead = np.argpartition(near, n - top, axis=1)[:, n - top:]
                exact = np.where(np.take_along_axis(own, ahead, 1), -np.inf, np.einsum("btd,bd->bt", x[ahead], q[part]))
                floor = np.partition(exact, top - k, axis=1)[:, top - k] - blur[part] if top >= k else np.full(len(near), -np.inf)  # k rows reach it
                could = ~(near + slack * sizes[part, None] + 1e-36 < floor[:, None]) & ~own
                alive = np.flatnonzero(could.any(axis=0))
                could, score = could[:, alive], q[part] @ x[alive].T
                for m in range(len(near)):
                    rows = alive[could[m] & ~(score[m] < floor[m])]
                    if len(rows) > k:
                        best = q[at + m] @ x[rows].T
                        rows = rows[~(best < np.partition(best, len(rows) - k)[len(rows) - k] - 2 * blur[at + m])]
                    exactly = products(x[rows], q[at + m])
                    best = np.lexsort((ids[rows], -exactly))[:k]
                    out.append(pd.DataFrame({"query_id": asks[at + m], "vec_id": ids[rows][best], "score": exactly[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return scan


def search(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product, scores exact in doubles.

    Every row is indexed and scanned by its four-bit codes. A block of about VECTORS rows reranks the best rerank * k
    by tables first; the k-th exact score of these is a floor, and every row whose table score and slack reach it is
    reranked too. So no row that belongs to the k best is left out, whatever the vectors are; where they lie so that
    codes tell little (long residuals), more rows are reranked. A block sends k rows a query.
    A row with the query's vec_id is never its own answer; ties go to the smaller vec_id; with
    fewer than k other rows all are returned. Rows without an id or a vector, with a zero or an empty one, or with
    null or non-finite components take no part; a query meets only vectors of its dimension. Repeated rows all
    count. Other columns are not read.
    """
    some = lambda r: r.where(F.exists("vec", lambda x: x != 0))
    index, books = build_index(some(usable(df, id_col, vec_col)).withColumn("row", F.monotonically_increasing_id()))
    index = written(index, "ann-index")
    asks = written(some(usable(queries, id_col, vec_col)).withColumn("asked", F.monotonically_increasing_id()), "ann-queries")
    nv, nq = (max(1, -(-x.count() // per)) for x, per in ((index, VECTORS), (asks, QUERIES)))
    # vectors that came as floats travel as floats, which loses nothing; the products are of doubles
    light = F.col("vec").cast("array<float>" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>")
    left = sent_to(dealt(index.select("row", "vec_id", light.alias("vec"), "codes", "slack", F.size("vec").alias("dim")), "vb", nv, "row"), "qb", nq)
    right = sent_to(dealt(asks.withColumn("dim", F.size("vec")), "qb", nq, "asked"), "vb", nv)
    keys = ("dim", "vb", "qb")
    return best_of(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_scan(books, k, rerank * k), FOUND), k)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector: edge cases as for search()."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 20 = 0"), k=20)


#: The exact answers, to measure recall against.
EXACT_SQL = """
with vecs as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
scores as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from vecs q join vecs c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
