"""Sampler pieces against brute force and the sampling law."""

import numpy as np
from pyspark.sql import functions as F

from rankfold.functions.hashing import uniform
from rankfold.operators import norms as N
from rankfold.operators import sampling as S
from rankfold.operators.prefix import cdf_lookup, column_cdf, prefix_sums


def test_prefix_sums_match_cumsum(spark):
    rng = np.random.default_rng(0)
    keys = rng.choice(10 ** 9, size=3000, replace=False)
    w = rng.integers(0, 100, size=3000).astype(float)
    df = spark.createDataFrame([(int(k), float(x)) for k, x in zip(keys, w)], "k bigint, w double")
    for buckets in (1, 3, 16):
        out = prefix_sums(df, "k", {"s": F.col("w"), "c": F.lit(1)}, buckets).collect()
        got = {r["k"]: (r["s_lo"], r["c_lo"]) for r in out}
        order = np.argsort(keys)
        cs = np.concatenate([[0.0], np.cumsum(w[order])[:-1]])
        for rank, idx in enumerate(order):
            assert got[int(keys[idx])] == (cs[rank], rank)


def test_cdf_lookup_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    # one heavy column holding most of the mass, many tiny and some zero-width ones
    b = np.concatenate([[5000.0], rng.integers(0, 3, size=400).astype(float)])
    bn = spark.createDataFrame([(int(j), float(x)) for j, x in enumerate(b)], "j bigint, b double")
    cdf = column_cdf(bn, buckets=8)
    total = float(b.sum())
    draws = spark.range(5000).select(F.col("id").alias("t"), (uniform(3, "x", F.col("id")) * F.lit(total)).alias("x"))
    got = {r["t"]: r["j"] for r in cdf_lookup(draws, "x", cdf, "j", total, buckets=8).collect()}
    xs = {r["t"]: r["x"] for r in draws.collect()}
    hi = np.cumsum(b)
    lo = hi - b
    assert len(got) == 5000
    for t, x in xs.items():
        j = int(np.searchsorted(hi, x, side="right"))
        assert lo[j] <= x < hi[j]
        assert got[t] == j


def _law_setup(spark, n1=40, n2=60, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 50, size=n1).astype(float)
    b = rng.integers(0, 50, size=n2).astype(float)
    a_n = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "i bigint, a double")
    b_n = spark.createDataFrame([(j, float(x)) for j, x in enumerate(b)], "j bigint, b double")
    return a, b, a_n, b_n


def test_sampler_same_for_any_partitioning(spark):
    a, b, a_n, b_n = _law_setup(spark)
    m = 600.0
    res = []
    for parts in (1, 3, 16):
        s = S.sample_adaptive(a_n.repartition(parts), b_n.repartition(parts), m, len(a), len(b), a.sum(), b.sum(), 5)
        res.append(sorted((r["i"], r["j"]) for r in s.collect()))
    assert res[0] == res[1] == res[2]
    assert len(res[0]) > 0


def test_sample_law_frequencies(spark):
    """Draw frequencies of the mixture sampler follow q_i(j)."""
    a, b, a_n, b_n = _law_setup(spark, n1=1, n2=30, seed=2)
    n1, n2 = 1, len(b)
    alloc = a_n.withColumn("m_i", F.lit(20000).cast("bigint"))
    cdf = column_cdf(b_n)
    d = S._draws(alloc, 9)
    ub = uniform(9, "branch", F.col("i"), F.col("t"))
    uc = uniform(9, "col", F.col("i"), F.col("t"))
    an = F.col("a") * F.lit(float(n1))
    d = d.withColumn("_unif", ub * (an + F.lit(float(a.sum()))) < an).withColumn("_uc", uc)
    uni = d.where("_unif").withColumn("idx", F.floor(F.col("_uc") * F.lit(float(n2))).cast("bigint")) \
        .join(cdf.select("idx", "j"), "idx").select("j")
    hit = cdf_lookup(d.where(~F.col("_unif")).withColumn("_x", F.col("_uc") * F.lit(float(b.sum()))),
                     "_x", cdf, "j", float(b.sum())).select("j")
    counts = {r["j"]: r["n"] for r in uni.unionByName(hit).groupBy("j").agg(F.count("*").alias("n")).collect()}
    q = a[0] / (n2 * a.sum()) + b / (n1 * b.sum())
    q = q / q.sum()
    freq = np.array([counts.get(j, 0) for j in range(n2)]) / 20000.0
    assert sum(counts.values()) == 20000
    assert np.max(np.abs(freq - q)) < 5 * np.sqrt(q.max() / 20000)


def test_bernoulli_mask_expected_count(spark):
    a, b, a_n, b_n = _law_setup(spark, n1=80, n2=90, seed=4)
    m = 1500.0
    p = m / 2 * (a[:, None] / (len(b) * a.sum()) + b[None, :] / (len(a) * b.sum()))
    s = S.sample_bernoulli(a_n, b_n, m, len(a), len(b), a.sum(), b.sum(), 11)
    n = s.count()
    mu = np.minimum(p, 1).sum()
    sd = np.sqrt((np.minimum(p, 1) * (1 - np.minimum(p, 1))).sum())
    assert abs(n - mu) < 5 * sd


def test_heavy_rows_use_bernoulli_branch(spark):
    a, b, a_n, b_n = _law_setup(spark, n1=5, n2=20, seed=5)
    m = 400.0  # m_i ~ 40-80 > 20 / log2(20): every row is heavy
    alloc = S.row_allocation(a_n, m, 5, a.sum())
    assert alloc.where(S.heavy_condition(20)).count() == 5
    s = S.sample_adaptive(a_n, b_n, m, 5, 20, a.sum(), b.sum(), 1)
    assert s.count() > 0
    assert s.select(F.max("p")).first()[0] > 0


def test_norms_zero_column(spark):
    cells = spark.createDataFrame([("A", 0, 0, 0.0), ("A", 1, 1, 2.0), ("B", 0, 5, 1.0)],
                                  "mat string, row bigint, col bigint, val double")
    n = {(r["mat"], r["col"]): r["norm2"] for r in N.col_norms2(cells).collect()}
    assert n[("A", 0)] == 0.0 and n[("A", 1)] == 4.0 and n[("B", 5)] == 1.0


def test_bernoulli_thinned_law(spark):
    """Independent Bernoulli(min(1, x + w·b)) without enumerating pairs:
    per-column frequencies over many identical rows match the law."""
    rng = np.random.default_rng(8)
    n_rows, n_cols = 400, 150
    b = np.concatenate([[0.0, 0.0], rng.exponential(1.0, size=n_cols - 4), [60.0, 200.0]])
    x, w = 0.01, 0.02
    rows = spark.createDataFrame([(i, x, w) for i in range(n_rows)], "i bigint, x double, w double")
    cols = spark.createDataFrame([(j, float(v)) for j, v in enumerate(b)], "j bigint, b double")
    got = S.bernoulli_thinned(rows, cols, seed=4).collect()
    pairs = {(r["i"], r["j"]) for r in got}
    assert len(pairs) == len(got)  # no duplicates
    p = np.minimum(1.0, x + w * b)
    freq = np.zeros(n_cols)
    for _, j in pairs:
        freq[j] += 1
    sd = np.sqrt(n_rows * p * (1 - p)) + 1e-9
    assert np.all(np.abs(freq - n_rows * p) <= 5 * sd + 1e-9)
    assert freq[-1] == n_rows and freq[-2] == n_rows  # p >= 1: always kept
    total_sd = np.sqrt((n_rows * p * (1 - p)).sum())
    assert abs(len(pairs) - n_rows * p.sum()) < 5 * total_sd


def test_one_sample_at_every_size(spark):
    """The mask of some rows is the same whichever other rows there are: no
    switch by the number of cells."""
    a, b, a_n, b_n = _law_setup(spark, n1=80, n2=90, seed=4)
    m, some = 1500.0, F.col("i") < 10
    args = (m, len(a), len(b), a.sum(), b.sum(), 11)
    every = S.sample_bernoulli(a_n, b_n, *args).where(some).select("i", "j").collect()
    few = S.sample_bernoulli(a_n.where(some), b_n, *args).select("i", "j").collect()
    assert sorted(every) == sorted(few) and every


def test_adaptive_heavy_rows_follow_the_law(spark):
    a, b, a_n, b_n = _law_setup(spark, n1=5, n2=40, seed=6)
    m = 600.0
    alloc = S.row_allocation(a_n, m, 5, a.sum()).collect()
    assert all(r["m_i"] * np.log2(40) > 40 for r in alloc)
    q = (a[:, None] / (40 * a.sum()) + b[None, :] / (5 * b.sum())) / (a[:, None] / a.sum() + 1 / 5)
    mi = np.array([r["m_i"] for r in sorted(alloc, key=lambda r: r["i"])])[:, None]
    p = np.minimum(1, mi * q)
    n = S.sample_adaptive(a_n, b_n, m, 5, 40, a.sum(), b.sum(), 3).count()
    assert abs(n - p.sum()) < 5 * np.sqrt((p * (1 - p)).sum())


def test_coordinates_beyond_two_to_the_32(spark):
    from rankfold.operators import sketch as K
    coords = K.pick_coords(7, 1 << 38, 300)
    assert len(set(coords)) == 300 and max(coords) > 1 << 36 and max(coords) < 1 << 38
    assert [r["h"] for r in K.coords_frame(spark, 7, 1 << 38, 300).orderBy("t").collect()] == coords


def test_draws_are_not_broadcast(spark):
    """However few bytes the chunks of draws take, the draws meet the columns by a merge."""
    alloc = spark.range(50).select(F.col("id").alias("i"), F.lit(1.0).alias("a"), F.lit(40).cast("bigint").alias("m_i"))
    cdf = column_cdf(spark.range(100).select(F.col("id").alias("j"), F.lit(1.0).alias("b")))
    out = S.sample_cdf(alloc, cdf, 50, 100, 50.0, 100.0, 3)
    assert out.count() > 0 and out.where("j IS NULL OR j NOT BETWEEN 0 AND 99").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [idx" in plan and "BroadcastHashJoin [idx" not in plan
