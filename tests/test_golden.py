"""Golden 4 x 3 example: values computed independently with numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.functions import arrays as AR
from rankfold.operators import factorize as FZ
from rankfold.operators import norms as N
from rankfold.operators import product as P
from rankfold.operators import sampling as S
from rankfold.operators import sketch as K

from matrices import A_ROWS, B_ROWS


def as_dense(rows, n1=3, n2=3, key=("i", "j"), val="val"):
    m = np.zeros((n1, n2))
    for r in rows:
        m[r[key[0]], r[key[1]]] = r[val]
    return m


def test_product_exact(golden):
    m = as_dense(P.product_exact(golden).collect())
    assert np.array_equal(m, np.array([[3, 6, 5], [6, 1, 4], [4, 6, 3]]))


def test_norms_and_frobenius(golden):
    n = {(r["mat"], r["col"]): r["norm2"] for r in N.col_norms2(golden).collect()}
    assert [n[("A", c)] for c in range(3)] == [6, 6, 11]
    assert [n[("B", c)] for c in range(3)] == [6, 10, 6]
    f = {r["mat"]: r["fro2"] for r in N.frobenius2(N.col_norms2(golden)).collect()}
    assert f == {"A": 23, "B": 22}


def test_budget_allocation_probability(golden):
    norms = N.col_norms2(golden)
    tot = N.norm_totals(norms)
    bud = S.sample_budget(tot["n1"], tot["n2"], 1, 2.0)
    assert bud["m"] == 8
    alloc = {r["i"]: r["m_i"] for r in S.row_allocation(S.a_side(norms), bud["m"], 3, 23.0).collect()}
    assert alloc == {0: 2, 1: 2, 2: 3}
    allcells = golden.sparkSession.createDataFrame([(i, j) for i in range(3) for j in range(3)], "i bigint, j bigint")
    p = S.cell_probability(allcells, S.a_side(norms), S.b_side(norms), bud["m"], 3, 3, 23.0, 22.0)
    pm = as_dense(p.collect(), val="p")
    want = np.array([[0.711462, 0.953887, 0.711462]] * 2 + [[1.001318, 1.243742, 1.001318]])
    assert np.allclose(pm, want, atol=1e-6)
    assert abs(pm.sum() - 8) < 1e-9
    # row sums equal the unrounded row budgets
    share = 8 * (1 / 6 + np.array([6, 6, 11]) / 46)
    assert np.allclose(pm.sum(axis=1), share)


def test_hadamard_natural_order(spark):
    df = spark.createDataFrame([(i, [1.0 if k == i else 0.0 for k in range(4)]) for i in range(4)], "i int, v array<double>")
    rows = {r["i"]: r["h"] for r in df.select("i", AR.hadamard(F.col("v"), 4).alias("h")).collect()}
    h = np.array([rows[i] for i in range(4)]).T  # column i = H e_i
    assert np.array_equal(h, np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]))
    assert np.array_equal(h @ h, 4 * np.eye(4))


def test_srht_fixed_signs_and_coords(spark):
    """SRHT with signs (+,-,+,+) and coordinates {1, 2} (natural order), k = 2."""
    a = np.array(A_ROWS, float)
    b = np.array(B_ROWS, float)
    rows = [("A", c, a[:, c].tolist()) for c in range(3)] + [("B", c, b[:, c].tolist()) for c in range(3)]
    v = spark.createDataFrame(rows, "mat string, col bigint, vec array<double>")
    signs = [1.0, -1.0, 1.0, 1.0]
    sk = AR.gather(AR.hadamard(AR.times_literal(F.col("vec"), signs), 4), [1, 2])
    got = {(r["mat"], r["col"]): np.array(r["s"]) / math.sqrt(2) for r in v.select("mat", "col", sk.alias("s")).collect()}
    r2 = math.sqrt(2)
    assert np.allclose(got[("A", 0)], [r2, -r2]) and np.allclose(got[("A", 1)], [r2, 0])
    assert np.allclose(got[("A", 2)], [1.5 * r2, -2.5 * r2])
    assert np.allclose(got[("B", 0)], [r2, 0]) and np.allclose(got[("B", 1)], [2 * r2, -2 * r2])
    assert np.allclose(got[("B", 2)], [0, -r2])
    sa = np.array([got[("A", c)] for c in range(3)])
    sb = np.array([got[("B", c)] for c in range(3)])
    raw = sa @ sb.T
    assert np.allclose(raw, [[2, 8, 2], [2, 4, 0], [3, 16, 5]])
    # rescaled estimator (B9) through the operator
    wide = spark.createDataFrame([(m, c, got[(m, c)].tolist()) for (m, c) in got], "mat string, col bigint, sk array<double>")
    samples = spark.createDataFrame([(i, j) for i in range(3) for j in range(3)], "i bigint, j bigint")
    norms = N.col_norms2(spark.createDataFrame(
        [("A", r, c, float(a[r, c])) for r in range(4) for c in range(3)]
        + [("B", r, c, float(b[r, c])) for r in range(4) for c in range(3)], "mat string, row bigint, col bigint, val double"))
    res = as_dense(K.value_from_sketch(samples, wide, norms, "rescaled").collect())
    want = [[4.242641, 7.745967, 4.242641], [6, 5.477226, 0], [4.179783, 10.174940, 6.966305]]
    assert np.allclose(res, want, atol=1e-6)
    rawv = as_dense(K.value_from_sketch(samples, wide, None, "raw").collect())
    assert np.allclose(rawv, raw)


def test_full_srht_is_exact(golden):
    """k = N: ÃᵀB̃ = AᵀB for any signs (H Hᵀ = N I)."""
    n = K.padded_length(4)
    coords = K.pick_coords(3, n, n)
    assert sorted(coords) == list(range(n))
    wide = K.sketch_wide(K.srht_sketch_cells(golden, coords, 3), n)
    samples = golden.sparkSession.createDataFrame([(i, j) for i in range(3) for j in range(3)], "i bigint, j bigint")
    est = as_dense(K.value_from_sketch(samples, wide, None, "raw").collect())
    assert np.allclose(est, [[3, 6, 5], [6, 1, 4], [4, 6, 3]])


def test_wals_step_golden(spark):
    obs = spark.createDataFrame([(0, 0, 3.0, 1.0), (0, 1, 6.0, 0.5), (0, 2, 5.0, 2.0)], "i bigint, j bigint, val double, w double")
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "id bigint, f array<double>")
    u = FZ.wals_half_step(obs, v, 1, 0.1).collect()
    assert abs(u[0]["f"][0] - 1.848341232227488) < 1e-12


def test_value_exact_keeps_zero_cells(golden):
    s = golden.sparkSession.createDataFrame([(0, 0, 1.0), (2, 2, 1.0), (1, 1, 1.0)], "i bigint, j bigint, p double")
    got = {(r["i"], r["j"]): r["val"] for r in P.value_exact(golden, s).collect()}
    assert got == {(0, 0): 3.0, (2, 2): 3.0, (1, 1): 1.0}
    for first in ("A", "B", "rows", "auto"):
        assert {(r["i"], r["j"]): r["val"] for r in P.value_exact(golden, s, first).collect()} == got


def test_k_above_padded_length_raises():
    with pytest.raises(ValueError):
        K.pick_coords(1, 4, 5)
