"""End-to-end jobs and the driver contract."""

import numpy as np

from rankfold.plans import jobs
from rankfold.sources.generate import decay_matrix, decay_vecs_direct

from matrices import dense_cells


def test_two_pass_exact_rank_small_error(spark):
    rng = np.random.default_rng(11)
    d, n, r = 40, 30, 2
    a = rng.normal(size=(d, r)) @ rng.normal(size=(r, n))
    b = rng.normal(size=(d, r)) @ rng.normal(size=(r, n))
    cells = dense_cells(spark, a.tolist(), b.tolist(), keep_zeros=True)
    res = jobs.two_pass_factorize(spark, cells, rank=r, iters=15, ss=4.0, seed=3, power_iters=8)
    rep = {x["metric"]: x["value"] for x in res["report"].collect() if x["round"] == 0}
    assert rep["rel_error"] < 1e-3
    assert rep["samples"] > 0


def test_synthetic_errors_ordered(spark):
    out = {r["method"]: r["rel_error"] for r in
           jobs.synthetic_benchmark(spark, 48, 48, rank=3, k=32, iters=8, seed=1, power_iters=6).collect()}
    assert out["optimal"] > 0
    assert out["two_pass"] < 3 * out["optimal"]
    assert out["one_pass"] < 1.0


def test_decay_forms_agree(spark):
    cells = decay_matrix(spark, 8, 5, 1.0, 2)
    vecs = decay_vecs_direct(spark, 8, 5, 1.0, 2)
    c = {(r["mat"], r["row"], r["col"]): r["val"] for r in cells.collect()}
    for r in vecs.collect():
        for row, x in enumerate(r["vec"]):
            assert abs(c[(r["mat"], row, r["col"])] - x) < 1e-15


def test_entry_contract(spark):
    import __spark_entry__ as E

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40
    df = E.entry(spark)
    rows = {r["metric"] for r in df.collect()}
    assert {"budget", "samples", "rel_error"} <= rows
