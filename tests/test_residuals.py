"""Residual norms of several pairs at a time."""

import numpy as np

from matrices import dense_cells

from rankfold.operators import linop as L
from rankfold.plans import jobs


def _factor(spark, rows, skip=()):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows) if i not in skip], "id bigint, f array<double>")


def test_pairs_share_the_products(spark, monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(12, 9)), rng.normal(size=(12, 7))
    ops = L.Operands(dense_cells(spark, a.tolist(), b.tolist(), keep_zeros=True))
    pairs = [(_factor(spark, rng.normal(size=(9, 2)), skip), _factor(spark, rng.normal(size=(7, 2)))) for skip in ((), (3,))]
    made, product = [], L.Operands.product
    monkeypatch.setattr(L.Operands, "product", lambda self, *args: made.append(1) or product(self, *args))
    got = L.residual_norms(ops, pairs, 2, 4, 3)
    assert len(made) == 8  # two a round, whatever the number of pairs
    wanted = [L.residual_norm(ops, u, v, 2, 4, 3)[0] for u, v in pairs]
    ops.release()
    assert np.allclose(got, wanted, rtol=1e-12, atol=0)


def test_methods_compared_against_numpy(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(16, 24)), rng.normal(size=(16, 20))
    out = {r.method: r.rel_error for r in jobs.compare_methods(
        spark, dense_cells(spark, a.tolist(), b.tolist(), keep_zeros=True), rank=2, k=8, iters=3, ss=4.0, seed=2, power_iters=3).collect()}
    sigma = np.linalg.svd(a.T @ b, compute_uv=False)
    assert list(out) == ["optimal", "one_pass", "two_pass"]
    assert abs(out["optimal"] - sigma[2] / sigma[0]) < 1e-3 and all(np.isfinite(list(out.values())))
