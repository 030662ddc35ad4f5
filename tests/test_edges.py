"""Edge cases listed in FIXTURES.md §5."""

import numpy as np
from pyspark.sql import functions as F

from rankfold.functions import arrays as AR
from rankfold.operators import norms as N
from rankfold.operators import product as P
from rankfold.operators import sketch as K
from rankfold.sources.tables import cells_from_table


def test_hadamard_lengths_1_2_8(spark):
    for n in (1, 2, 8):
        rows = [(i, [1.0 if k == i else 0.0 for k in range(n)]) for i in range(n)]
        df = spark.createDataFrame(rows, "i int, v array<double>")
        got = {r["i"]: r["h"] for r in df.select("i", AR.hadamard(F.col("v"), n).alias("h")).collect()}
        h = np.array([got[i] for i in range(n)]).T
        want = np.array([[(-1) ** bin(a & b).count("1") for b in range(n)] for a in range(n)])
        assert np.array_equal(h, want)


def test_padding_and_length_three(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    out = df.select(AR.hadamard(AR.pad_to(F.col("v"), 3, 4), 4).alias("h")).first()["h"]
    assert out == [6.0, 2.0, 0.0, -4.0]


def test_zero_sketch_column_gives_zero_estimate(spark):
    wide = spark.createDataFrame([("A", 0, [0.0, 0.0]), ("B", 0, [1.0, 2.0])], "mat string, col bigint, sk array<double>")
    norms = spark.createDataFrame([("A", 0, 4.0), ("B", 0, 5.0)], "mat string, col bigint, norm2 double")
    s = spark.createDataFrame([(0, 0)], "i bigint, j bigint")
    r = K.value_from_sketch(s, wide, norms, "rescaled").first()
    assert r["val"] == 0.0


def test_zero_valued_sampled_cell_is_kept(spark):
    cells = spark.createDataFrame([("A", 0, 0, 1.0), ("B", 1, 0, 1.0), ("B", 0, 1, 2.0)],
                                  "mat string, row bigint, col bigint, val double")
    s = spark.createDataFrame([(0, 0, 0.3), (0, 1, 0.3)], "i bigint, j bigint, p double")
    got = {(r["i"], r["j"]): r["val"] for r in P.value_exact(cells, s).collect()}
    assert got == {(0, 0): 0.0, (0, 1): 2.0}


def test_duplicate_input_cells_are_summed(spark):
    t = spark.createDataFrame([(1, 7, 2.0), (1, 7, 3.0), (2, 7, 1.0)], "r bigint, c bigint, v double")
    cells = cells_from_table(t, "r", "c", "v", "A")
    n = N.col_norms2(cells).first()
    assert n["norm2"] == 26.0 and n["nnz"] == 2


def test_sketch_same_for_any_partitioning(spark):
    rng = np.random.default_rng(3)
    rows = [("A" if k % 2 else "B", int(rng.integers(0, 50)), int(rng.integers(0, 6)), float(rng.integers(1, 9)))
            for k in range(300)]
    base = spark.createDataFrame(rows, "mat string, row bigint, col bigint, val double") \
        .groupBy("mat", "row", "col").agg(F.sum("val").alias("val"))
    coords = K.pick_coords(2, 64, 8)
    outs = []
    for parts in (1, 3, 16):
        sk = K.srht_sketch_cells(base.repartition(parts), coords, 2, with_norms=True)
        outs.append(sorted((r["mat"], r["col"], r["t"], r["s"]) for r in sk.collect()))
    assert outs[0] == outs[1] == outs[2]


def test_salted_joins_same_answer(spark):
    """Force every key hot (min_rows=1): salting must not change results."""
    from rankfold.operators import linop as L

    rng = np.random.default_rng(5)
    rows = [("A", 0, int(c), float(rng.integers(1, 5))) for c in range(40)]  # one hot row
    rows += [("B", 0, int(c), float(rng.integers(1, 5))) for c in range(30)]
    rows += [("A", int(r), int(rng.integers(0, 40)), 1.0) for r in range(1, 60)]
    rows += [("B", int(r), int(rng.integers(0, 30)), 2.0) for r in range(1, 60)]
    cells = spark.createDataFrame(rows, "mat string, row bigint, col bigint, val double") \
        .groupBy("mat", "row", "col").agg(F.sum("val").alias("val"))
    plain = sorted(tuple(r) for r in P.product_exact(cells, detect_skew=False).collect())
    salted = sorted(tuple(r) for r in P.product_exact(cells, min_rows=1).collect())
    assert plain == salted
    s = spark.createDataFrame([(i, j, 0.1) for i in range(0, 40, 3) for j in range(0, 30, 4)], "i bigint, j bigint, p double")
    v1 = sorted(tuple(r) for r in P.value_exact(cells, s, detect_skew=False).collect())
    v2 = sorted(tuple(r) for r in P.value_exact(cells, s, min_rows=1).collect())
    assert v1 == v2
    for plan in ("B", "rows"):
        assert sorted(tuple(r) for r in P.value_exact(cells, s, plan, min_rows=1).collect()) == v1
    x = spark.createDataFrame([(j, float(j) - 7.0) for j in range(30)], "id bigint, val double")
    o1 = L.Operands(cells, persist=False, detect_skew=False)
    o2 = L.Operands(cells, persist=False, min_rows=1)
    assert any(o2.hot.values())
    y1 = {r["id"]: r["val"] for r in L.apply_product(o1, x).collect()}
    y2 = {r["id"]: r["val"] for r in L.apply_product(o2, x).collect()}
    assert y1.keys() == y2.keys() and all(abs(y1[k] - y2[k]) < 1e-9 for k in y1)


def test_rows_hot_on_either_or_both_sides_are_laid_out_on_a_grid(spark):
    from rankfold.operators.skew import grid_join, hot_products

    rows = [("A", 0, i, 1.0) for i in range(60)] + [("B", 0, j, float(j)) for j in range(60)]  # hot in both
    rows += [("A", 1, 3, 2.0)] + [("B", 1, j, 1.0) for j in range(400)]                        # hot in B alone
    rows += [("A", 2 + k, k, 1.0) for k in range(20)] + [("B", 2 + k, k, 1.0) for k in range(20)]
    cells = spark.createDataFrame(rows, "mat string, row bigint, col bigint, val double")
    got = {(r["i"], r["j"]): r["val"] for r in P.product_exact(cells, min_rows=100).collect()}
    want = {(r["i"], r["j"]): r["val"] for r in P.product_exact(cells, detect_skew=False).collect()}
    assert got == want
    from rankfold.sources.tables import split
    a, b = split(cells)
    hot = hot_products(a, b, "row", parts=16, min_pairs=100)
    assert {h[0] for h in hot} == {0, 1}
    pairs = grid_join(a, b, "row", "i", "j", hot).groupBy("row", "_line", "_column").count().collect()
    share = sum(r["count"] for r in pairs) / 16
    assert sum(r["count"] for r in pairs) == 60 * 60 + 400 + 20
    assert max(r["count"] for r in pairs) < 4 * share
    samples = spark.createDataFrame([(i, j) for i in range(0, 60, 7) for j in range(0, 60, 5)], "i bigint, j bigint")
    exact = {(r["i"], r["j"]): r["val"] for r in P.value_exact(cells, samples, "rows", min_rows=100).collect()}
    assert exact == {k: want.get(k, 0.0) for k in exact} and len(exact) == samples.count()
