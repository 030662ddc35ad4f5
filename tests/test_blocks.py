"""Blocked Hadamard transform, chunked columns and tiled sampled products."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.functions.hashing import py_sign
from rankfold.operators import factorize as FZ
from rankfold.operators import hadamard as HD
from rankfold.operators import product as P
from rankfold.operators import sketch as K
from rankfold.operators import tiles as T


def dense_hadamard(n):
    h = np.array([[1.0]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def some_cells(spark, n, seed=3):
    """Columns with one cell, a few and all rows."""
    rng = random.Random(seed)
    data = {}
    for mat, col, m in (("A", 0, 1), ("A", 1, 40), ("A", 7, n), ("B", 0, n // 2), ("B", 1 << 40, 3)):
        for r in rng.sample(range(n), m):
            data[mat, r, col] = float(rng.randint(-9, 9))
    rows = [(m, r, c, v) for (m, r, c), v in data.items()]
    return data, spark.createDataFrame(rows, "mat string, row bigint, col bigint, val double").repartition(5)


def expected(data, n, coords, seed):
    h = dense_hadamard(n)[coords] / np.sqrt(len(coords))
    x = {}
    for (mat, r, c), v in data.items():
        x.setdefault((mat, c), np.zeros(n))[r] = v
    signs = np.array([py_sign(seed, "sign", r) for r in range(n)])
    return {key: (h @ (signs * v), float(v @ v)) for key, v in x.items()}


def check(frame, want):
    rows = frame.collect()
    got = {(r.mat, r.col): (np.array(r.sk), r.norm2) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    for key, (sk, norm2) in want.items():
        np.testing.assert_allclose(got[key][0], sk, atol=1e-9)
        assert got[key][1] == pytest.approx(norm2)


def test_fast_transform_is_the_hadamard_matrix():
    x = np.random.default_rng(1).normal(size=(3, 64))
    np.testing.assert_allclose(HD.fast_transform(x.copy()), x @ dense_hadamard(64), atol=1e-12)


@pytest.mark.parametrize("n, k, split", [(1, 1, 22), (64, 64, 22), (2048, 300, 22), (2048, 7, 8), (2048, 300, 4)])
def test_blocked_sketch_equals_the_matrix(spark, monkeypatch, n, k, split):
    monkeypatch.setattr(HD, "SPLIT_BITS", split)
    monkeypatch.setattr(HD, "FEW", 10)
    monkeypatch.setattr(HD, "ELEMENTS", 5000)  # columns reach over many pieces
    data, cells = some_cells(spark, max(n, 1)) if n > 100 else ({("A", r, 5): float(r + 1) for r in range(n)}, None)
    if cells is None:
        cells = spark.createDataFrame([(m, r, c, v) for (m, r, c), v in data.items()], "mat string, row bigint, col bigint, val double")
    coords = K.pick_coords(5, n, k)
    check(K.srht_sketch_wide(cells, coords, 5, n), expected(data, n, coords, 5))


@pytest.mark.parametrize("size", [16, 256, 2048])
def test_chunked_columns(spark, monkeypatch, size):
    monkeypatch.setattr(HD, "ELEMENTS", 5000)
    n, d, k = 2048, 1500, 50
    rng = np.random.default_rng(2)
    vecs = {("A", c): rng.integers(-9, 9, d).astype(float) for c in range(3)} | {("B", 9): rng.integers(-9, 9, 700).astype(float)}
    frame = spark.createDataFrame([(m, c, v.tolist()) for (m, c), v in vecs.items()], "mat string, col bigint, vec array<double>").repartition(3)
    coords = K.pick_coords(5, n, k)
    want = expected({(m, r, c): x for (m, c), v in vecs.items() for r, x in enumerate(v)}, n, coords, 5)
    check(K.srht_sketch_chunks(HD.chunked(frame, size), d, coords, 5, size), want)
    # chunks dealt at random meet again
    check(K.srht_sketch_chunks(HD.chunked(frame, size).repartition(7), d, coords, 5, size), want)
    norms = {(r.mat, r.col): r.norm2 for r in HD.chunk_norms(HD.chunked(frame, size)).collect()}
    assert norms == {key: pytest.approx(n2) for key, (_, n2) in want.items()}
    cells = frame.select("mat", F.posexplode("vec").alias("row", "val"), "col").where("val <> 0")
    again = HD.chunks_of_cells(cells, size)
    check(K.srht_sketch_chunks(again, d, coords, 5, size), want)


def test_plan_does_not_grow_with_d(spark):
    def plan(d):
        vecs = spark.createDataFrame([("A", 1, [1.0, 2.0])], "mat string, col bigint, vec array<double>")
        return len(K.srht_sketch_vecs(vecs, d, [0, 1], 5)._jdf.queryExecution().toString())
    assert plan(10_000_000) == pytest.approx(plan(10_000), rel=0.02)


def test_a_million_rows_in_one_column(spark):
    d = 1_000_000
    vecs = spark.range(2).select(F.lit("A").alias("mat"), F.col("id").alias("col"), F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)), lambda r: ((r + F.col("id").cast("int")) % 5).cast("double")).alias("vec"))
    coords = [0, 5, 1 << 19]
    got = {r.col: np.array(r.sk) for r in K.srht_sketch_vecs(vecs, d, coords, 5).collect()}
    signs = np.array([py_sign(5, "sign", r) for r in range(d)])
    rows = np.arange(d)
    for c in (0, 1):
        x = signs * ((rows + c) % 5)
        want = [(x * (1 - 2 * (np.bitwise_count(rows & h) & 1).astype(float))).sum() / np.sqrt(3) for h in coords]
        np.testing.assert_allclose(got[c], want)


@pytest.mark.parametrize("tiles, most, size", [((1, 1), 10 ** 9, 8), ((3, 5), 10 ** 9, 8), ((2, 2), 20, 8), ((2, 3), 30, 3)])
def test_tiled_dots_equal_the_product(spark, monkeypatch, tiles, most, size):
    """Hot i, ids without a vector, several parts of a tile, chunks of which the last is shorter."""
    monkeypatch.setattr(T, "SAMPLES", most)
    monkeypatch.setattr(T, "ELEMENTS", 50)
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(20, 8)), rng.normal(size=(30, 8))
    rows = [("A", i, x.tolist()) for i, x in enumerate(a)] + [("B", j, x.tolist()) for j, x in enumerate(b)]
    vecs = spark.createDataFrame(rows, "mat string, col bigint, vec array<double>").repartition(4)
    cells = [(0, j, 0.5, "s") for j in range(31)] + [(i, i % 7, 0.25, None) for i in range(1, 22)]
    samples = spark.createDataFrame(cells, "i bigint, j bigint, p double, note string").repartition(3)
    want = {(i, j): (p, t, float(a[i] @ b[j]) if i < 20 and j < 30 else 0.0) for i, j, p, t in cells}
    dots = T.tiled_dots(samples, HD.chunked(vecs, size), size, tiles)
    total = dots.groupBy("i", "j").agg(F.sum("dot").alias("dot"), F.first("rest").alias("rest"))
    got = T.with_values(samples, total, F.col("dot")).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.p, r.note) == want[r.i, r.j][:2] and r.val == pytest.approx(want[r.i, r.j][2])
    exact = P.value_exact_vecs(vecs, samples, size).collect()
    assert {(r.i, r.j): pytest.approx(r.val) for r in exact} == {c: v[2] for c, v in want.items()}


def test_sketches_move_once_per_tile(spark):
    """The exchange holds copies of the sketches by the size of the grid, however many samples there are."""
    vecs = spark.createDataFrame([(m, c, 0, [1.0] * 16) for m in "AB" for c in range(40)], "mat string, col bigint, chunk int, vec array<double>")
    samples = spark.range(1600).select((F.col("id") % 40).alias("i"), F.floor(F.col("id") / 40).alias("j"))
    lines, columns = T.grid(40, 40, 16, 8)
    rows = T.tiled_dots(samples, vecs, 16, (lines, columns))
    assert rows.count() == 1600 and 40 * columns + 40 * lines < 2 * 1600


def als_case(spark):
    rng = np.random.default_rng(0)
    u, v = rng.normal(size=(40, 3)), rng.normal(size=(30, 3))
    m = u @ v.T
    cells = [(i, j, float(m[i, j]), float(1 + (i + j) % 3)) for i in range(40) for j in range(30) if i == 3 or rng.random() < 0.5]
    observed = spark.createDataFrame(cells, "i bigint, j bigint, val double, w double").repartition(5)
    other = spark.createDataFrame([(j, v[j].tolist()) for j in range(25)], "id bigint, f array<double>")  # some have no factor
    want = {}
    for i in range(40):
        g, h = 0.1 * np.eye(3), np.zeros(3)
        for a, j, x, w in cells:
            if a == i and j < 25:
                g += w * np.outer(v[j], v[j])
                h += w * x * v[j]
        want[i] = np.linalg.solve(g, h)
    return observed, other, want, m


@pytest.mark.parametrize("cells, split", [(500_000, False), (12, True)])
def test_half_step_on_blocks(spark, cells, split):
    observed, other, want, _ = als_case(spark)
    by = FZ.blocks(observed, "i", "j", cells)
    assert by.split == split
    step = FZ.half_step(by, other, 3, 0.1)
    got = {r.id: np.array(r.f) for r in step.collect()}
    assert set(got) == set(want)
    for i, f in want.items():
        np.testing.assert_allclose(got[i], f, atol=1e-9)
    plan = step._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange hashpartitioning(block" not in plan and "Exchange hashpartitioning(to" in plan
    by.release()


def test_als_on_blocks_finds_the_factors(spark):
    observed, _, _, m = als_case(spark)
    u, v = FZ.wals(observed, spark.range(30), 3, iters=12)
    uu, vv = ({r.id: np.array(r.f) for r in x.collect()} for x in (u, v))
    assert max(abs(uu[i] @ vv[j] - m[i, j]) for i in range(40) for j in range(30)) < 0.02
    none = observed.where("i < 0")
    assert FZ.wals_half_step(none, v, 3).collect() == []
