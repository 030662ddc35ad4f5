"""Implicit products, power iteration, subspace iteration and ALS."""

import numpy as np
from pyspark.sql import functions as F

from rankfold.operators import factorize as FZ
from rankfold.operators import linop as L
from rankfold.operators import product as P

from matrices import dense_cells


def _pair(spark, d=30, n1=12, n2=9, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    if rank:
        a = rng.normal(size=(d, rank)) @ rng.normal(size=(rank, n1))
        b = rng.normal(size=(d, rank)) @ rng.normal(size=(rank, n2))
    else:
        a = rng.normal(size=(d, n1)) / np.arange(1, d + 1)[:, None]
        b = rng.normal(size=(d, n2)) / np.arange(1, d + 1)[:, None]
    return a, b, dense_cells(spark, a.tolist(), b.tolist(), keep_zeros=True)


def _vec(df, n):
    x = np.zeros(n)
    for r in df.collect():
        x[r["id"]] = r["val"]
    return x


def test_apply_product_both_ways(spark):
    a, b, cells = _pair(spark)
    ops = L.Operands(cells, persist=False)
    x = spark.createDataFrame([(j, float(j + 1)) for j in range(9)], "id bigint, val double")
    y = _vec(L.apply_product(ops, x), 12)
    assert np.allclose(y, a.T @ (b @ np.arange(1, 10)))
    yy = spark.createDataFrame([(i, float(i - 3)) for i in range(12)], "id bigint, val double")
    z = _vec(L.apply_product_t(ops, yy), 9)
    assert np.allclose(z, b.T @ (a @ (np.arange(12) - 3.0)))


def test_spectral_norm_and_svd(spark):
    a, b, cells = _pair(spark, seed=3)
    m = a.T @ b
    s = np.linalg.svd(m, compute_uv=False)
    ops = L.Operands(cells)
    est, trace = L.spectral_norm(ops, iters=40, seed=1)
    assert len(trace) == 40 and abs(est - s[0]) / s[0] < 1e-6
    sig, u, v = L.svd_exact(ops, 3, iters=60, seed=2)
    assert np.allclose(sig, s[:3], rtol=1e-6)
    opt = L.optimal_error(ops, 2, iters=60, seed=2)
    assert abs(opt["opt_error"] - s[2] / s[0]) < 1e-6
    ops.release()


def test_residual_of_exact_factors_is_zero(spark):
    a, b, cells = _pair(spark, seed=4, rank=2)
    m = a.T @ b
    uu, ss, vt = np.linalg.svd(m)
    u = spark.createDataFrame([(i, (uu[i, :2] * ss[:2]).tolist()) for i in range(12)], "id bigint, f array<double>")
    v = spark.createDataFrame([(j, vt[:2, j].tolist()) for j in range(9)], "id bigint, f array<double>")
    ops = L.Operands(cells)
    e = L.relative_error(ops, u, v, 2, iters=5, seed=1)
    ops.release()
    assert e["rel_error"] < 1e-6


def test_wals_recovers_exact_rank(spark):
    rng = np.random.default_rng(7)
    n1, n2, r = 30, 25, 2
    m = rng.normal(size=(n1, r)) @ rng.normal(size=(r, n2))
    mask = rng.random((n1, n2)) < 0.6
    mask[0, :] = False
    mask[0, 3] = True  # a row with one sample (< r): least-norm solve at λ = 0
    obs = spark.createDataFrame([(i, j, float(m[i, j]), 1.0) for i in range(n1) for j in range(n2) if mask[i, j]],
                                "i bigint, j bigint, val double, w double")
    v_ids = spark.range(n2)
    u, v = FZ.wals(obs, v_ids, r, iters=25, lam=0.0, seed=3)
    uf = {x["id"]: x["f"] for x in u.collect()}
    vf = {x["id"]: x["f"] for x in v.collect()}
    est = np.array([[np.dot(uf.get(i, [0, 0]), vf.get(j, [0, 0])) for j in range(n2)] for i in range(n1)])
    err = np.linalg.norm((est - m)[1:]) / np.linalg.norm(m[1:])
    assert err < 1e-3
    assert np.all(np.isfinite(est))


def test_factor_matrix_fills_missing(spark):
    f = spark.createDataFrame([(1, [1.0, 2.0])], "id bigint, f array<double>")
    ids = spark.createDataFrame([(1,), (2,), (3_000_000_000,)], "id bigint")
    got = {r["id"]: r["f"] for r in FZ.factor_matrix(ids, f, 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3_000_000_000: [0.0, 0.0]}


def test_reconstruct_and_random_init(spark):
    ids = spark.range(50)
    v = FZ.random_init(ids, 3, seed=4)
    g = L.gram(v, 3)
    assert np.allclose(g, np.eye(3), atol=1e-10)
    u = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id bigint, f array<double>")
    cells = spark.createDataFrame([(0, 5), (1, 5)], "i bigint, j bigint")
    vv = {r["id"]: r["f"] for r in v.collect()}
    got = {r["i"]: r["est"] for r in FZ.reconstruct(cells, u, v).collect()}
    assert abs(got[0] - float(np.dot([1, 2, 3], vv[5]))) < 1e-12 and got[1] == 0.0


def test_product_ids_beyond_int(spark):
    big = 5_000_000_000
    cells = spark.createDataFrame([("A", big, big + 1, 2.0), ("B", big, 7, 3.0), ("B", 1, 8, 1.0)],
                                  "mat string, row bigint, col bigint, val double")
    got = [(r["i"], r["j"], r["val"]) for r in P.product_exact(cells).collect()]
    assert got == [(big + 1, 7, 6.0)]


def _pair_with(spark, sigma, n=14):
    """Cells of A = I·U·diag(σ) form: AᵀB has exactly these singular values."""
    rng = np.random.default_rng(3)
    u, _ = np.linalg.qr(rng.normal(size=(n, n)))
    v, _ = np.linalg.qr(rng.normal(size=(n, n)))
    r = len(sigma)
    cells = [("A", t, i, float(u[i, t])) for t in range(r) for i in range(n)]
    cells += [("B", t, j, float(v[j, t] * sigma[t])) for t in range(r) for j in range(n)]
    return spark.createDataFrame(cells, "mat string, row bigint, col bigint, val double").repartition(2).cache()


def test_svd_small_values_rank_deficit_and_flat_tail(spark):
    for sigma, wanted in (((1.0, 1e-4, 1e-9), 3), ((2.0, 0.5), 3), ((1.0, 0.25, 0.24, 0.23, 0.22), 3)):
        ops = L.Operands(_pair_with(spark, sigma), detect_skew=False)
        got = L.svd(ops, wanted, iters=60, seed=2)
        truth = (list(sigma) + [0.0] * wanted)[:wanted]
        assert got["converged"]
        assert np.allclose(got["sigmas"], truth, rtol=0.01, atol=1e-12), got
        assert np.allclose(got["sigmas"], truth, atol=1e-6 * truth[0])
        ops.release()


def test_svd_says_when_it_has_not_converged(spark):
    import pytest
    ops = L.Operands(_pair_with(spark, [1.0 - 0.001 * k for k in range(14)]), detect_skew=False)
    with pytest.raises(RuntimeError, match="still move"):
        L.svd_exact(ops, 2, iters=2, tol=1e-12)
    ops.release()


def test_mllib_als_takes_any_ids(spark):
    big = 5_000_000_000
    obs = spark.createDataFrame([(big + i, j - big, float((i + 1) * (j + 1)), 1.0) for i in range(6) for j in range(5)],
                                "i bigint, j bigint, val double, w double")
    u, v = FZ.factorize_als(obs, 1, 10, 1e-6, 1)
    uf, vf = {x["id"]: x["f"][0] for x in u.collect()}, {x["id"]: x["f"][0] for x in v.collect()}
    assert set(uf) == {big + i for i in range(6)} and abs(uf[big + 5] * vf[4 - big] - 30.0) < 0.5
