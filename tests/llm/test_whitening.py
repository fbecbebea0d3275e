"""Whitening against a plain eigendecomposition, and its whole-number parts against each other."""

import numpy as np
import pytest

from barsmith.llm import whitening as w

SCHEMA = "vec_id long, embedding array<double>, component string"


def brute(vectors, most=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def test_against_plain_eigenvectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()
    got = w.op13(spark, "/root/testdata/sf0.001").toPandas()
    n, deviation, white, explained = brute([r.embedding for r in rows])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[[r.vec_id for r in rows]].to_numpy()
    sign = np.sign((wide * white).sum(axis=0))
    assert np.abs(wide * sign - white).max() < 1e-9
    first = got[got["component"] == 1].set_index("vec_id").loc[[r.vec_id for r in rows]]
    assert first["deviation"].tolist() == deviation and set(got["n"]) == {n}
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-12)
    assert got["identity_error"].max() < 1e-9


def test_odd_rows_ties_and_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), "x") for i in range(60)]
    rows += [(None, rows[0][1], None), (0, rows[0][1], "x"), (100, None, "x"), (101, [], "x"), (102, [1.0, None, 2.0, 3.0], "x"), (103, [float("nan")] * 4, "x"), (104, [float("inf"), 0.0, 0.0, 0.0], "x")]
    rows += [(200 + i, [float(i % 3), float(i % 2)], "x") for i in range(12)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    four, two = got[got["n"] == 60], got[got["n"] == 6]
    assert len(four) == 62 * 4 and len(two) == 12 * 2 and len(four) + len(two) == len(got)
    assert four["vec_id"].isna().sum() == 4 and (four["vec_id"] == 0).sum() == 8
    same = four[(four["vec_id"].isna()) | (four["vec_id"] == 0)].groupby("component")["whitened"].nunique()
    assert (same == 1).all()
    assert got["identity_error"].max() < 1e-9


def test_equal_roots_low_rank_and_nothing(spark):
    corners = [(i, [float(x) for x in ((i & 1) * 2 - 1, (i >> 1 & 1) * 2 - 1, (i >> 2 & 1) * 2 - 1, 5)], "x") for i in range(8)]
    got = w.whiten(spark.createDataFrame(corners, SCHEMA)).toPandas()  # three equal eigenvalues, one that is zero
    assert len(got) == 8 * 3 and np.allclose(got["explained"], 1 / 3) and got["identity_error"].max() < 1e-12
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide.T @ wide / 8, np.eye(3))
    assert w.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x")] * 3, SCHEMA)).count() == 0
    assert w.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_entries_are_exact(spark):
    rows = [(i, [float(2**50 * (i + 1)), float(-(2**49) * i * i), float(2**45 * i**3)], "x") for i in range(9)]
    got = w.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    _, deviation, _, _ = brute([r[1] for r in rows])
    first = got[got["component"] == 1].sort_values("vec_id")
    assert [int(x) for x in first["deviation_digits"]] == deviation and first["deviation"].isna().all()
    assert len(got) == 27 and got["identity_error"].max() < 1e-9
    with pytest.raises(Exception, match="62 bits"):
        w.whiten(spark.createDataFrame([(1, [1e300], "x"), (2, [1.0], "x")], SCHEMA)).count()


def test_polynomial_roots_and_null_spaces():
    rng = np.random.default_rng(5)
    b = rng.integers(-9, 10, size=(7, 5))
    a = b @ b.T  # of rank 5
    moduli = w.primes(200)
    found = [w.polynomial_mod(a, p) for p in moduli]
    poly = [w.remainder_theorem([int(f[k]) for f in found], moduli) for k in range(8)]
    product = int(np.prod([int(p) for p in moduli], dtype=object))
    poly = [c - product if c > product // 2 else c for c in poly]
    want = np.poly(a.astype(float))[::-1]
    assert np.allclose([float(c) for c in poly], want, rtol=1e-6, atol=1e-9 * max(map(abs, want))) and poly[0] == poly[1] == 0
    roots = np.linalg.eigvalsh(a)[::-1]
    assert w.roots_above(poly, 0) == 5 and w.roots_above(poly, int(roots[1])) == 2
    for k in range(5):
        x = w.isolate(poly, k + 1, 1 << 20, 120)
        assert abs(x / 2**120 - roots[k]) < 1e-8 * roots[0]
        vector = np.array(w.null_space(a.tolist(), int(np.trace(a)), x, 120, 1, k)[0])
        assert np.abs(a @ vector - roots[k] * vector).max() < 1e-9 * roots[0] and abs(vector @ vector - 1) < 1e-12
    double = [4, -4, 1]  # (t - 2)**2: never one root by itself
    assert all(abs(w.isolate(double, k, 8, 60) / 2**60 - 2) < 1e-15 for k in (1, 2))


def test_limbs():
    for v in (0, 1, -1, 2**30, -(2**95) - 12345, 10**40):
        assert sum(x << w.LIMB * k for k, x in enumerate(w.limbs(v))) == v
