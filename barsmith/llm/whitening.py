"""Whitening of embeddings by the exact characteristic polynomial of their whole-number scatter."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import batches_of, written

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 16
#: Bits that follow the leading bit of the trace in an enclosure of a root; roots closer than CLOSE bits are one group.
ROOT_BITS, CLOSE_BITS = 192, 112
#: Fraction bits of the numbers in which null spaces are iterated, and steps of that iteration.
FRACTION, STEPS = 640, 3
#: Bits of the limbs in which tasks send exact sums, so that sums of limbs stay within 64 bits.
LIMB = 30
#: Entries of vectors that a task takes into one step.
ENTRIES = 1 << 21


# Sums of the fit list


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, y, dim: y = floor(SCALE * c) of each entry (the shift cancels in all that is centred)."""
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    large = F.raise_error(F.lit(f"an entry times {SCALE} does not fit into 62 bits"))
    whole = lambda c: F.when(F.abs(c) < 2.0**62 / SCALE, F.floor(c * SCALE)).otherwise(large).cast("long")
    return rows.where(~F.exists("vec", odd)).select("vec_id", F.transform("vec", whole).alias("y"), F.size("vec").alias("dim"))


def _matrix(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _parts(batch: pa.RecordBatch, name: str, dim: int) -> Iterator[np.ndarray]:
    y = _matrix(batch, name, dim)
    rows = max(1, ENTRIES // dim)
    for at in range(0, len(y), rows):
        yield y[at:at + rows]


def gram(y: np.ndarray) -> np.ndarray:
    """The exact product of y's transpose with y, as Python integers."""
    top = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    if top * top * len(y) < 1 << 53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y if top * top * len(y) < 1 << 63 else y.astype(object)
    return (z.T @ z).astype(object)


def limbs(value: int) -> list[int]:
    """The value as signed digits in base 2**LIMB, lowest first."""
    out, sign, value = [], -1 if value < 0 else 1, abs(value)
    while value:
        out.append(sign * (value & (1 << LIMB) - 1))
        value >>= LIMB
    return out


@dataclass
class Fit:
    """n vectors of the fit list, the sums of their entries, and n * (sum of products) - S S', whole numbers all."""

    n: int
    sums: list[int]
    scatter: list[list[int]]

    @property
    def trace(self) -> int:
        return sum(row[i] for i, row in enumerate(self.scatter))


def fit_sums(distinct: DataFrame, dim: int) -> Fit:
    """Exact sums over all rows of distinct (y): every task sends one matrix, in limbs, whatever it read."""
    row, col = np.triu_indices(dim)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dim, dtype=object), np.zeros((dim, dim), dtype=object)
        for batch in batches:
            for y in _parts(batch, "y", dim):
                n += len(y)
                sums = sums + y.astype(object).sum(axis=0)
                products = products + gram(y)
        cells = [(-1, -1, n)] + [(i, -1, s) for i, s in enumerate(sums)] + [(int(i), int(j), products[i, j]) for i, j in zip(row, col, strict=True)]
        flat = [(i, j, k, v) for i, j, value in cells for k, v in enumerate(limbs(int(value)))]
        if flat:
            i, j, k, v = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64())], ["i", "j", "limb", "value"])

    cells = distinct.select("y").mapInArrow(partial, "i int, j int, limb int, value long").groupBy("i", "j", "limb").agg(F.sum("value").alias("value"))
    total: dict[tuple[int, int], int] = {}
    for r in cells.collect():  # a matrix of dim x dim, whatever the number of rows
        total[r.i, r.j] = total.get((r.i, r.j), 0) + (r.value << LIMB * r.limb)
    n, sums = total.get((-1, -1), 0), [total.get((i, -1), 0) for i in range(dim)]
    scatter = [[n * total.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    return Fit(n, sums, scatter)


# The characteristic polynomial


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every n below 3.4e14."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7, 11, 13, 17)):
        return n in (2, 3, 5, 7, 11, 13, 17)
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes under 2**31, largest first, whose product has more than so many bits."""
    out: list[int] = []
    have = 0.0
    for p in range((1 << 31) - 1, 2, -2):
        if have > bits:
            break
        if is_prime(p):
            out.append(p)
            have += math.log2(p)
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to a, modulo p, with zeros below the first subdiagonal."""
    h = a % p
    n = len(h)
    for m in range(1, n - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - a) modulo p, lowest power first, from the Hessenberg form."""
    h = hessenberg(a, p)
    n = len(h)
    found = np.zeros((n + 1, n + 1), dtype=np.int64)  # row m: the polynomial of the leading m x m block
    found[0, 0] = 1
    for m in range(1, n + 1):
        row = np.zeros(n + 1, dtype=np.int64)
        row[1:] = found[m - 1, :-1]
        row = (row - int(h[m - 1, m - 1]) * found[m - 1]) % p
        below = 1
        for i in range(m - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            if not below:
                break
            row = (row - below * int(h[i - 1, m - 1]) % p * found[i - 1]) % p
        found[m] = row
    return found[n]


def remainder_theorem(residues: list[int], moduli: list[int]) -> int:
    """The number in [0, product of the moduli) with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value


def characteristic(spark: SparkSession, fit: Fit) -> list[int]:
    """Coefficients of det(t I - scatter), lowest power first, exactly.

    The scatter has no negative root, so the coefficient of t**(d - k) is (-1)**k times a number that Maclaurin's
    inequality bounds by C(d, k) (trace / d)**k. There are primes enough for the largest of these; each task
    reduces the matrix modulo its own primes, and each coefficient is put together from its residues.
    """
    d = len(fit.sums)
    bound = max((math.comb(d, k) * fit.trace**k // d**k).bit_length() for k in range(d + 1)) + 1
    moduli = primes(bound)
    shared = spark.sparkContext.broadcast(fit.scatter)  # d x d numbers

    def residues(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batch["id"]:
                p = moduli[at]
                a = np.array([[x % p for x in row] for row in shared.value], dtype=np.int64)
                found = polynomial_mod(a, p)
                found[d - 1::-2] = -found[d - 1::-2] % p  # signs taken away
                yield pd.DataFrame({"power": range(d + 1), "modulus": p, "residue": found})

    def together(group: pd.DataFrame) -> pd.DataFrame:
        value = remainder_theorem(group["residue"].tolist(), group["modulus"].tolist())
        return pd.DataFrame({"power": [int(group["power"].iloc[0])], "value": [str(value)]})

    tasks = max(1, min(len(moduli), 2 * spark.sparkContext.defaultParallelism))
    found = spark.range(0, len(moduli), 1, tasks).mapInPandas(residues, "power int, modulus long, residue long")
    values = {r.power: int(r.value) for r in found.groupBy("power").applyInPandas(together, "power int, value string").collect()}
    return [(-1) ** (d - k) * values[k] for k in range(d + 1)]


# Its roots


def shifted(poly: list[int], x: int) -> list[int]:
    """Coefficients of poly(x + t)."""
    out = list(poly)
    if x:
        for i in range(len(out) - 1):
            for j in range(len(out) - 2, i - 1, -1):
                out[j] += x * out[j + 1]
    return out


def roots_above(poly: list[int], x: int) -> int:
    """Roots beyond x, with their multiplicity: as all roots are real, exactly the changes of sign of poly(x + t)."""
    signs = [c > 0 for c in shifted(poly, x) if c]
    return sum(a != b for a, b in itertools.pairwise(signs))


def stretched(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2**bits times those of poly."""
    d = len(poly) - 1
    return [c << bits * (d - k) for k, c in enumerate(poly)]


def isolate(poly: list[int], k: int, top: int, bits: int) -> int:
    """x such that the k-th largest root, a positive one, lies in (x, x + 1] / 2**bits; all roots are at most top.

    Halving by counts of roots until one root is left in the interval, then by signs. The grid gets finer in steps,
    so that long numbers are only used where roots lie close together.
    """
    lo, hi, fine, scale = 0, top, poly, 0
    above_lo, above_hi = roots_above(poly, 0), 0
    while True:
        while hi - lo > 1 and above_lo - above_hi > 1:
            mid = (lo + hi) // 2
            above = roots_above(fine, mid)
            lo, above_lo, hi, above_hi = (mid, above, hi, above_hi) if above >= k else (lo, above_lo, mid, above)
        if scale == bits or above_lo - above_hi == 1:
            break
        step = min(48, bits - scale)
        scale += step
        fine, lo, hi = stretched(poly, scale), lo << step, hi << step
    lo, hi = lo << bits - scale, hi << bits - scale

    def value(x: int) -> int:  # of the sign of poly(x / 2**bits)
        out = 0
        for i, c in enumerate(reversed(poly)):
            out = out * x + (c << bits * i)
        return out

    if hi - lo > 1:  # one simple root: the sign beyond it is that of (-1)**(roots above)
        beyond = -1 if above_hi % 2 else 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            v = value(mid) * beyond
            lo, hi = (lo, mid) if v >= 0 else (mid, hi)
    return lo


# Its null spaces


def null_space(scatter: list[list[int]], trace: int, root: int, bits: int, size: int, seed: int) -> list[list[float]]:
    """Orthonormal vectors that span the null space, of that size, of scatter - root / 2**bits.

    Inverse iteration in whole numbers with FRACTION fraction bits, the matrix scaled by its trace: one
    elimination with row exchanges, then STEPS solutions, made orthogonal to each other after each.
    """
    d = len(scatter)
    a = np.array([[(x << FRACTION) // trace for x in row] for row in scatter], dtype=object).reshape(d, d)
    mu = ((2 * root + 1) << FRACTION) // (trace << bits + 1)
    for i in range(d):
        a[i, i] -= mu
    order = list(range(d))
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[i, k]] = a[[k, i]]
            order[i], order[k] = order[k], order[i]
        a[k, k] = a[k, k] or 1
        if k + 1 < d:
            f = (a[k + 1:, k] << FRACTION) // a[k, k]
            a[k + 1:, k + 1:] -= (f[:, None] * a[k, k + 1:]) >> FRACTION
            a[k + 1:, k] = f

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for k in range(d - 1):
            x[k + 1:] -= (a[k + 1:, k] * x[k]) >> FRACTION
        for k in range(d - 1, -1, -1):
            x[k] = (x[k] << FRACTION) // a[k, k]
            x[:k] -= (a[:k, k] * x[k]) >> FRACTION
        return x

    def unit(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            norm = math.isqrt(int((x * x).sum())) or 1
            x = np.array([(int(v) << FRACTION) // norm for v in x], dtype=object)
            for o in others:
                x = x - ((int((x * o).sum()) >> FRACTION) * o >> FRACTION)
        return x

    rng = np.random.default_rng(seed)
    block = [np.array([int(v) << FRACTION for v in rng.integers(1, 1 << 20, d)], dtype=object) for _ in range(size)]
    for _ in range(STEPS):
        done: list[np.ndarray] = []
        for b in block:
            done.append(unit(solved(b.copy()), done))
        block = done
    return [[int(v) / (1 << FRACTION) for v in b] for b in block]


@dataclass
class Components:
    """Unit eigenvectors of the covariance, by falling eigenvalue, with roots of the scatter and shares of the trace."""

    vectors: np.ndarray
    roots: np.ndarray
    explained: np.ndarray


def components(spark: SparkSession, fit: Fit, most: int = COMPONENTS) -> Components:
    """The components with a positive eigenvalue, most of them at most. Each root and each null space is found by a
    task of its own, from the polynomial and the scatter, which do not grow with the table."""
    d, trace = len(fit.sums), fit.trace
    if not trace:
        return Components(np.zeros((0, d)), np.zeros(0), np.zeros(0))
    poly = characteristic(spark, fit)
    m = min(most, roots_above(poly, 0))
    bits = max(0, ROOT_BITS - trace.bit_length())
    shared = spark.sparkContext.broadcast((poly, fit.scatter))

    def root(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["id"]:
                yield pd.DataFrame({"k": [k], "root": [str(isolate(shared.value[0], int(k) + 1, 1 << trace.bit_length(), bits))]})

    roots = [int(r.root) for r in sorted(spark.range(0, m, 1, m).mapInPandas(root, "k long, root string").collect(), key=lambda r: r.k)]
    close = (trace << bits) >> CLOSE_BITS
    firsts = [k for k in range(m) if not k or roots[k - 1] - roots[k] > close]
    groups = list(zip(firsts, [*firsts[1:], m], strict=True))

    def vectors(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch["id"]:
                a, b = groups[g]
                found = null_space(shared.value[1], trace, roots[a], bits, b - a, a)
                yield pd.DataFrame({"k": range(a, b), "vector": found})

    found = {r.k: r.vector for r in spark.range(0, len(groups), 1, len(groups)).mapInPandas(vectors, "k long, vector array<double>").collect()}
    values = [(2 * r + 1) / (1 << bits + 1) for r in roots]
    return Components(np.array([found[k] for k in range(m)]), np.array(values), np.array([(2 * r + 1) / (trace << bits + 1) for r in roots]))


# Projections


def projected(y: np.ndarray, fit: Fit, found: Components) -> np.ndarray:
    """Whitened coordinates: the centred vectors, n * y - S as whole numbers, on the components, over the roots' square
    roots. The factor n of both cancels."""
    top = max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0
    wide = fit.n * top + max(map(abs, fit.sums)) >= 1 << 63
    centred = (y.astype(object) * fit.n - np.array(fit.sums, dtype=object)) if wide else (y * fit.n - np.array(fit.sums, dtype=np.int64))
    return centred.astype(np.float64) @ found.vectors.T / np.sqrt(found.roots)


def deviations(y: np.ndarray, fit: Fit) -> list[int]:
    """The sum over dimensions of (n * y - S)**2, exactly."""
    top = fit.n * max(abs(int(y.min())), abs(int(y.max()))) + max(map(abs, fit.sums))
    kind = np.int64 if top * top * y.shape[1] < 1 << 63 else object
    centred = y.astype(kind) * fit.n - np.array(fit.sums, dtype=kind)
    return [int(x) for x in (centred * centred).sum(axis=1)]


def identity_error(distinct: DataFrame, fit: Fit, found: Components) -> float:
    """The largest absolute entry of (covariance of the whitened fit list - identity): counts, sums and products of all
    rows, centred in each batch and put together about the common mean."""
    m, dim = len(found.roots), len(fit.sums)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(m), np.zeros((m, m))
        for y in (y for batch in batches for y in _parts(batch, "y", dim)):
            w = projected(y, fit, found)
            k, mean = len(w), w.mean(axis=0)
            n, sums, products = n + k, sums + k * mean, products + (w - mean).T @ (w - mean) + k * np.outer(mean, mean)
        if n:
            cells = [(-1, 0, float(n)), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, products[i, j]) for i in range(m) for j in range(m))]
            i, j, v = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], ["i", "j", "value"])

    cells = {(r.i, r.j): r.value for r in distinct.select("y").mapInArrow(merged, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}
    n = cells[-1, 0]
    mean = np.array([cells[i, -1] for i in range(m)]) / n
    products = np.array([[cells[i, j] for j in range(m)] for i in range(m)]) / n - np.outer(mean, mean)
    return float(np.abs(products - np.eye(m)).max())


WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, deviation_digits string"


def whiten(df: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue and
    deviation_digits (the deviation as a decimal number).

    An entry c counts as floor(64 * c) + 1000000. The fit list has each distinct vector once; all sums over it are
    whole numbers. Components are those of the covariance with a positive eigenvalue, so there are fewer than asked
    for where the vectors span fewer dimensions, and none (no rows) where all vectors are equal or there are none.
    Equal eigenvalues get some orthonormal basis of their space, the same for all rows.

    Rows with a null or empty vector, or with null or non-finite entries, are dropped. Null ids stay; repeated rows
    are returned as often as they came and count once in the fit list. Vectors of each dimension are whitened among
    themselves. An entry over 2**56 is an error. deviation is null where it does not fit into 64 bits, deviation_digits
    never. Other columns are not read.
    """
    spark = df.sparkSession
    batches_of(spark, 4096)
    rows = scaled(df, id_col, vec_col)
    id_type = dict(rows.dtypes)["vec_id"]
    distinct = written(rows.select("dim", "y").distinct(), "whitening-fit")
    out = None
    for dim in sorted(r.dim for r in distinct.select("dim").distinct().collect()):  # one number in all usual tables
        fit_list, here = distinct.where(F.col("dim") == dim), rows.where(F.col("dim") == dim).select("vec_id", "y")
        part = _whitened(here, fit_list, dim, most, id_type)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"vec_id {id_type}, {WHITENED}") if out is None else out


def _whitened(rows: DataFrame, fit_list: DataFrame, dim: int, most: int, id_type: str) -> DataFrame:
    fit = fit_sums(fit_list, dim)
    found = components(rows.sparkSession, fit, most)
    m = len(found.roots)
    error = identity_error(fit_list, fit, found) if m else 0.0
    values = found.roots / float(fit.n) ** 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for y in _parts(batch, "y", dim):
                k = len(y)
                exact = deviations(y, fit)
                again = np.repeat(np.arange(at, at + k), m)
                fits = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
                local = pa.array(again - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(again)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)), pa.array(np.full(k * m, fit.n, dtype=np.int64)),
                        fits.take(local), pa.array(projected(y, fit, found).ravel()), pa.array(np.tile(found.explained, k)), pa.array(np.full(k * m, error)),
                        pa.array(np.tile(values, k)), pa.array([str(x) for x in exact]).take(local),
                    ],
                    ["vec_id", *(x.split()[0] for x in WHITENED.split(", "))],
                )
                at += k

    return rows.mapInArrow(run, f"vec_id {id_type}, {WHITENED}") if m else rows.sparkSession.createDataFrame([], f"vec_id {id_type}, {WHITENED}")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened coordinates of every vector: edge cases as for whiten()."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
