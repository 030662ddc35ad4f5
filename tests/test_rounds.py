"""Power rounds of the norm and of the residual share their products; laid out pairs keep no second copy of the cells."""

import numpy as np

from matrices import dense_cells

from rankfold.operators import linop as L
from rankfold.operators import skew


def _factor(spark, rows):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id bigint, f array<double>")


def _power(r, x, iters):
    out, x = [], x / np.linalg.norm(x)
    for _ in range(iters):
        z = r.T @ (r @ x)
        out.append(np.sqrt(np.linalg.norm(z)))
        x = z / np.linalg.norm(z)
    return out


def test_norm_and_residual_share_the_products(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b, u, v = (rng.normal(size=s) for s in ((30, 6), (30, 5), (6, 2), (5, 2)))
    cells = dense_cells(spark, a.tolist(), b.tolist(), keep_zeros=True)
    made, product = [], L.Operands.product
    monkeypatch.setattr(L.Operands, "product", lambda self, *args: made.append(1) or product(self, *args))
    for least in (0, 10 ** 9):  # blocks of rows, and joins
        ops = L.Operands(cells, lay_out_from=least)
        made.clear()
        got = L.relative_error(ops, _factor(spark, u), _factor(spark, v), 2, 3, 5)
        assert len(made) == 6  # two a round; apart, both would take four
        assert (ops.laid() is not None) == (least == 0)
        assert ops.a.is_cached == ops.b.is_cached == (least > 0)  # blocks hold the cells already
        ops.release()
        for trace, matrix, purpose in (("norm_trace", a.T @ b, "start"), ("residual_trace", u @ v.T - a.T @ b, "resid")):
            start = {r["id"]: r["val"] for r in L.random_start(spark.range(5), 5, purpose).collect()}
            wanted = _power(matrix, np.array([start[j] for j in range(5)]), 3)
            assert [k for k, _ in got[trace]] == [1, 2, 3] and np.allclose([e for _, e in got[trace]], wanted, rtol=1e-12, atol=0)


def test_hot_keys_count_only_keys_of_full_classes(spark, monkeypatch):
    rows = [(0, c) for c in range(60)] + [(r, r % 7) for r in range(1, 41)]
    df = spark.createDataFrame(rows, "row bigint, i bigint")
    wanted = {"row": [(0, 5)], "i": []}
    assert skew.hot_keys_many(df, ["row", "i"], parts=8, min_rows=13) == wanted
    monkeypatch.setattr(skew, "CLASSES", 1)  # all keys in one class
    assert skew.hot_keys_many(df, ["row", "i"], parts=8, min_rows=13) == wanted
