"""The Bloom sieve before joins, sampled products behind it, and the Gaussian sketch by rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfold.functions import hashing as H
from rankfold.functions.hashing import py_uniform
from rankfold.operators import product as P
from rankfold.operators import sketch as K
from rankfold.operators.sieve import SLOTS, sieved, words

CELLS = "mat string, row bigint, col bigint, val double"


def test_no_wanted_key_is_lost_and_few_others_pass(spark):
    df = spark.range(20_000).select(F.col("id").alias("i"), (F.col("id") * 2).alias("_x"))
    keys = spark.range(0, 20_000, 100).select(F.col("id").alias("i"))
    got = {r["i"] for r in sieved(df, "i", keys).collect()}
    assert set(range(0, 20_000, 100)) <= got and len(got) < 230
    assert sieved(df, "i", keys).columns == df.columns
    # too few slots for the keys: more pass, none is lost
    small = {r["i"] for r in sieved(df, "i", keys, 64).collect()}
    assert set(range(0, 20_000, 100)) <= small
    assert words(spark.range(100_000).withColumnRenamed("id", "i"), "i", 1024).count() == 16 and SLOTS // 64 == 262_144


def test_edges(spark):
    df = spark.createDataFrame([(None, 1), (-5, 2), (3, 3), (3, 3)], "i bigint, x int")
    keys = spark.createDataFrame([(None,), (-5,), (3,)], "i bigint")
    assert {(-5, 2), (3, 3)} <= {tuple(r) for r in sieved(df, "i", keys).collect()}
    assert sieved(df, "i", keys).where("i = 3").count() == 2  # repeated rows stay
    assert sieved(df, "i", keys.where("i > 10")).count() == 0 and sieved(df.where("x > 9"), "i", keys).count() == 0
    with pytest.raises(ValueError):
        sieved(df, "i", keys, 100)


def _hot(spark):
    """Row 0 holds more than a third of all cells, column 3 of A too."""
    rng = np.random.default_rng(5)
    data = {("A", 0, c): 1.0 + c % 7 for c in range(120)} | {("B", 0, c): 2.0 - c % 3 for c in range(40)}
    data |= {("A", r, 3): float(r % 5) + 1 for r in range(90)}
    data |= {(m, int(r), int(c)): float(rng.integers(1, 9)) for m in "AB" for r, c in rng.integers(0, 40, (120, 2))}
    return data, spark.createDataFrame([(*k, v) for k, v in data.items()], CELLS)


@pytest.mark.parametrize("plan", ["A", "B", "rows", "auto"])
def test_hot_rows_and_columns(spark, plan):
    data, cells = _hot(spark)
    pairs = [(i, j) for i in range(0, 120, 3) for j in range(0, 40, 5)] + [(999, 0)]
    samples = spark.createDataFrame([(i, j, 0.5) for i, j in pairs], "i bigint, j bigint, p double")
    got = {(r["i"], r["j"]): r["val"] for r in P.value_exact(cells, samples, plan, min_rows=20).collect()}
    for i, j in pairs:
        want = sum(v * data.get(("B", r, j), 0.0) for (m, r, c), v in data.items() if m == "A" and c == i)
        assert math.isclose(got[i, j], want, abs_tol=1e-9), (i, j)
    assert len(got) == len(pairs)


def test_joins_see_sampled_columns_only(spark):
    cells = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("mat"), (F.col("id") % 97).alias("row"),
                                       (F.col("id") % 4001).alias("col"), F.lit(1.0).alias("val")).distinct()
    samples = spark.createDataFrame([(10, 11), (10, 13)], "i bigint, j bigint")
    a, b = P.sampled_sides(cells, samples)
    assert {r["i"] for r in a.select("i").distinct().collect()} <= {10, *range(4001)} and a.select("i").distinct().count() < 5
    assert a.where("i = 10").count() == cells.where("mat = 'A' AND col = 10").count()
    assert b.select("j").distinct().count() < 6
    assert P.choose_plan(cells, samples)[1] == {
        "A": cells.where("mat = 'A' AND col = 10").count() / cells.where("mat = 'A'").count(),
        "B": cells.where("mat = 'B' AND col IN (11, 13)").count() / cells.where("mat = 'B'").count()}
    assert P.choose_plan(cells.where("mat = 'A'"), samples)[1]["B"] == 0.0


@pytest.mark.parametrize("k", [1, 16, 37])
def test_gaussian_sketch_by_rows(spark, k):
    data, cells = _hot(spark)
    draws = {}

    def g(t, r):
        if (t, r) not in draws:
            draws[t, r] = math.sqrt(-2 * math.log(py_uniform(7, "jl.r", t, r))) * math.cos(2 * math.pi * py_uniform(7, "jl.t", t, r))
        return draws[t, r]

    want = {}
    for (m, r, c), v in data.items():
        for t in range(k):
            want[m, c, t] = want.get((m, c, t), 0.0) + v * g(t, r) / math.sqrt(k)
        want[m, c, -1] = want.get((m, c, -1), 0.0) + v * v
    for min_rows in (20, 200_000):
        got = {(r["mat"], r["col"], r["t"]): r["s"] for r in K.gaussian_sketch_cells(cells, k, 7, True, min_rows).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)
    assert {r["t"] for r in K.gaussian_sketch_cells(cells, k, 7).select("t").distinct().collect()} == set(range(k))
    assert K.gaussian_sketch_cells(cells.where("row < 0"), k, 7, True).count() == 0


def test_a_row_is_drawn_once(spark):
    """Only the plan of the distinct rows holds the hash."""
    _, cells = _hot(spark)
    plan = K.gaussian_sketch_cells(cells, 37, 7)._jdf.queryExecution().optimizedPlan().toString()
    with_hash = [line for line in plan.splitlines() if "md5(" in line]
    assert len(with_hash) == 1 and "Aggregate [row" in with_hash[0]


def test_rows_are_counted_and_drawn_from_one_reading(spark):
    """Beside the cells to be multiplied, the plan reads the rows' counts only, and draws the same as ``uniform``."""
    _, cells = _hot(spark)
    plan = K.gaussian_sketch_cells(cells.where("col != 987654321"), 5, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("987654321") == 1
    u1, u2 = (H.uniform(7, f"jl.{x}", F.lit(3), F.col("id")) for x in "rt")
    draws = spark.range(-50, 50).select(H.gaussian(7, "jl", F.lit(3), F.col("id")).alias("g"), (F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)).alias("h"))
    assert draws.where("g = h").count() == 100


def test_counted_rows_tell_the_same_hot_keys(spark):
    from rankfold.operators.skew import hot_counted, hot_keys
    _, cells = _hot(spark)
    counts = cells.groupBy("row").agg(F.count("*").alias("_n"))
    for least in (20, 200_000):
        assert hot_counted(counts, "row", min_rows=least) == (cells.count(), hot_keys(cells, "row", min_rows=least))
    assert hot_counted(counts.where("row < 0"), "row") == (0, [])
