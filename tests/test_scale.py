"""What tasks and the driver hold stays bounded as tables grow."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.operators import factorize as FZ
from rankfold.operators import linop as L
from rankfold.operators import sampling as S
from rankfold.plans import registry as R
from rankfold.sources import tables as TB

from matrices import dense_cells


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_of_als_are_not_broadcast(spark):
    rng = np.random.default_rng(3)
    cells = [(int(i), int(j), float(i * j % 7), 1.0) for i in range(40) for j in rng.choice(30, 6, replace=False)]
    by = FZ.blocks(spark.createDataFrame(cells, "i bigint, j bigint, val double, w double"))
    v = FZ.random_init(spark.range(30), 1, 5)
    assert "Broadcast" not in _plan(FZ.half_step(by, v, 1))  # their size on disk says little of their number
    by.release()


def test_observed_cells_are_stored_and_planned_by_cost(spark, monkeypatch):
    seen = []
    valued = R.P.value_exact
    monkeypatch.setattr(R.P, "value_exact", lambda cells, samples, first="A", *a, **k: seen.append(first) or valued(cells, samples, first, *a, **k))
    c = R._Ctx(spark, "/root/testdata/sf0.001")
    got = c.observed()
    assert seen == ["auto"] and not re.search("Join|Aggregate", got._jdf.queryExecution().logical().toString())
    exact = {(r["i"], r["j"]): r["val"] for r in valued(c.cells, c.drawn(), "A").collect()}
    assert {(r["i"], r["j"]): r["val"] for r in got.collect()} == exact


def test_draws_are_made_in_many_tasks(spark):
    alloc = spark.createDataFrame([(i, 1.0, 300) for i in range(40)], "i bigint, a double, m_i bigint")
    draws = S._draws(alloc, 1)
    assert draws.count() == 12_000
    # the chunks are a few bytes, of which adaptive execution had made one task
    assert draws.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tasks_that_add_up_cells_follow_the_rows(spark, monkeypatch):
    rows = [(r, r % 5, r % 3, 1.0) for r in range(60)] * 2
    df = spark.createDataFrame(rows, "r bigint, a bigint, b bigint, v double")
    monkeypatch.setattr(TB, "TASK_CELLS", 20)
    cells = TB.cells_pair_from_table(df, "r", "a", "b", "v")
    assert cells.rdd.getNumPartitions() == 12  # 240 contributions, 20 to a task
    got = {(x["mat"], x["row"], x["col"]): x["val"] for x in cells.collect()}
    assert got == {("A", r, r % 5): 2.0 for r in range(60)} | {("B", r, r % 3): 2.0 for r in range(60)}


def test_sketch_values_store_sketches_and_samples(spark):
    got = R._sketch_values(spark, "/root/testdata/sf0.001", "raw")
    logical = got._jdf.queryExecution().logical().toString()
    assert not re.search(r"Window|MapInArrow _?column_batches|Relation.*l_orderkey", logical)
    assert got.where(F.col("val").isNull()).count() == 0

def _tall(seed, d=400, n1=7, n2=5):
    rng = np.random.default_rng(seed)
    keep = rng.random((d, n1 + n2)) < 0.4
    return np.where(keep[:, :n1], rng.normal(size=(d, n1)), 0.0), np.where(keep[:, n1:], rng.normal(size=(d, n2)), 0.0)


@pytest.mark.parametrize("hot", [False, True])
def test_products_on_blocks_of_rows_move_no_cells(spark, hot):
    a, b = _tall(1)
    a[3], b[3] = 1.5, -0.5  # a full row
    cells = dense_cells(spark, a.tolist(), b.tolist()).repartition(3)
    ops = L.Operands(cells, lay_out_from=0, min_rows=8 if hot else None)
    if hot:
        ops.hot = {k: [] for k in ops.hot} | {"a_row": [(3, 2)]}
    assert ops.laid() is not None and (ops._rest is not None) == hot
    x = spark.createDataFrame([(j, float(j + 1), [float(j + 1), 1.0 - j]) for j in range(4)], "id bigint, val double, f array<double>")  # no entry for 4
    xs = np.array([[j + 1.0, 1.0 - j] for j in range(4)] + [[0.0, 0.0]])
    got = {r["id"]: r["val"] for r in L.apply_product(ops, x).collect()}
    assert np.allclose([got[i] for i in range(7)], a.T @ (b @ xs[:, 0]))
    two = {r["id"]: r["f"] for r in L.apply_product_block(ops, x, 2).collect()}
    assert np.allclose([two[i] for i in range(7)], a.T @ (b @ xs))
    back = {r["id"]: r["val"] for r in L.apply_product_t(ops, L.apply_product(ops, x)).collect()}
    assert np.allclose([back[j] for j in range(5)], b.T @ (a @ (a.T @ (b @ xs[:, 0]))))
    if not hot:  # a block's cells come from its file to the step without an exchange
        assert not re.search(r"Exchange[^\n]*block[^\n]*\n[^\n]*(FileScan|Project)[^\n]*\bat\b", _plan(L.apply_product(ops, x)))
        assert "Join" not in _plan(L.apply_product(ops, x))
    ops.release()


def test_singular_values_of_few_rows_take_few_rounds(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(20, 180)), rng.normal(size=(20, 160))
    b[5] = b[4]  # rank 19
    ops = L.Operands(dense_cells(spark, a.tolist(), b.tolist()))
    got = L.svd(ops, 3, iters=60, seed=2, tol=1e-10)
    truth = np.linalg.svd(a.T @ b, compute_uv=False)[:3]
    assert got["converged"] and got["rounds"] <= 4 and np.allclose(got["sigmas"], truth, rtol=1e-9)
    ops.release()


def test_tasks_of_a_product_follow_its_pairs(spark, monkeypatch):
    from rankfold.operators import product as P
    from rankfold.operators import skew

    monkeypatch.setattr(skew, "TASK_PAIRS", 100)
    a = np.arange(1.0, 401.0).reshape(40, 10)  # 40 rows of 100 pairs
    cells = dense_cells(spark, a.tolist(), a.tolist())
    found = {}
    assert skew.hot_products(*TB.split(cells), "row", found=found) == [] and found["tasks"] == 40
    got = P.product_exact(cells)
    assert _plan(got).count("hashpartitioning(row#") == 2 and ", 40), REPARTITION_BY_NUM" in _plan(got)
    assert {(r["i"], r["j"]): r["val"] for r in got.collect()} == {(i, j): v for i, x in enumerate((a.T @ a).tolist()) for j, v in enumerate(x)}


def test_a_sign_is_the_upper_half_of_its_hash(spark):
    from rankfold.functions import hashing as H

    signs = spark.range(500).select("id", H.sign(7, "sign", "id").alias("s"))
    assert "conv(" not in _plan(signs)  # one hex digit, no number made of thirteen
    assert all(r["s"] == H.py_sign(7, "sign", r["id"]) for r in signs.collect())


def test_no_null_arrays_are_handed_to_python(spark):
    from rankfold.operators import sketch as K
    from rankfold.operators import tiles as T

    cells = spark.range(400_000).selectExpr("'A' as mat", "id as row", "id % 40000 as col", "1.0D as val").coalesce(1)
    samples = spark.range(400_000).selectExpr("id % 1000 as i", "id div 1000 as j")
    vectors = spark.range(1400).selectExpr("if(id < 1000, 'A', 'B') as mat", "id % 1000 as col", "0L as chunk", "array(1.0D, 2.0D) as vec")
    for plan in (K.srht_sketch_wide(cells, [1, 2], 3, 1 << 19), T.tiled_dots(samples, vectors, 2, (1, 1))):
        assert "null AS sk" not in _plan(plan) and "null AS vec" not in _plan(plan)
        plan.write.format("noop").mode("overwrite").save()
