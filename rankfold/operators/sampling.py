"""Norm-biased cell sampling.

Rectangular form: A has n1 columns i with squared norms a_i (total F_A),
B has n2 columns j with b_j (total F_B).  With budget m,

    p_ij = (m/2)·(a_i/(n2·F_A) + b_j/(n1·F_B))      (sums to m)
    m_i  = floor(m·(1/(2·n1) + a_i/(2·F_A)) + 0.5)  (row budget)

Row i's draw law q(j) ∝ a_i/(n2·F_A) + b_j/(n1·F_B) is a mixture: with
probability a_i·n1/(a_i·n1 + F_A) a uniform column, otherwise a column
drawn from the one CDF of b shared by all rows.  So no per-row CDF is
ever built: uniform draws are an equi-join on the column's rank, CDF draws
one distributed sorted merge (prefix.cdf_lookup).  All randomness is
hashed from (seed, purpose, i, t) or (seed, purpose, i, j).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.hashing import uniform
from rankfold.operators.prefix import cdf_lookup, column_cdf

# rows with more draws than this are generated in chunks spread over tasks
DRAW_CHUNK = 4096
# draws of one task, about
TASK_DRAWS = 500_000


def sample_budget(n1: int, n2: int, rank: int, ss: float) -> dict:
    """G1: m = ss·ceil(n̄·r·ln n̄), n̄ = ceil((n1 + n2)/2)."""
    nbar = int(math.ceil((n1 + n2) / 2.0))
    m = float(ss) * math.ceil(nbar * rank * math.log(nbar)) if nbar > 1 else float(ss)
    return {"n1": int(n1), "n2": int(n2), "nbar": nbar, "m": m}


def a_side(norms: DataFrame) -> DataFrame:
    return norms.where(F.col("mat") == "A").select(F.col("col").alias("i"), F.col("norm2").alias("a"))


def b_side(norms: DataFrame) -> DataFrame:
    return norms.where(F.col("mat") == "B").select(F.col("col").alias("j"), F.col("norm2").alias("b"))


def row_allocation(a_norms: DataFrame, m: float, n1: int, fro_a: float) -> DataFrame:
    """(i, a, m_i), half-up rounding per row."""
    share = F.lit(1.0) / (F.lit(2.0) * F.lit(float(n1))) + F.col("a") / (F.lit(2.0) * F.lit(float(fro_a)))
    return a_norms.withColumn("m_i", F.floor(F.lit(float(m)) * share + F.lit(0.5)).cast("bigint"))


def cell_probability(samples: DataFrame, a_norms: DataFrame, b_norms: DataFrame, m: float,
                     n1: int, n2: int, fro_a: float, fro_b: float) -> DataFrame:
    """Add p = (m/2)·(a_i/(n2·F_A) + b_j/(n1·F_B)) to (i, j) rows; rows that bring a and b along need no join."""
    s = samples if {"a", "b"} <= set(samples.columns) else samples.join(a_norms.select("i", "a"), "i").join(b_norms.select("j", "b"), "j")
    p = F.lit(float(m)) / F.lit(2.0) * (F.col("a") / (F.lit(float(n2)) * F.lit(float(fro_a)))
                                       + F.col("b") / (F.lit(float(n1)) * F.lit(float(fro_b))))
    return s.withColumn("p", p).drop("a", "b")


def heavy_condition(n2: int):
    """G6 switch: dense Bernoulli branch when m_i·log2(n2) > n2."""
    return F.col("m_i") * F.log(F.lit(float(n2))) / F.log(F.lit(2.0)) > F.lit(float(n2))


def _draws(alloc: DataFrame, seed: int) -> DataFrame:
    """One row per draw (i, t), t = 1..m_i.  Long rows are first cut into
    chunks of DRAW_CHUNK, the chunks spread by hash, then expanded, so one
    hot column never puts all of its draws into one task.  The number of
    tasks follows the draws: of the chunks, which are few bytes, adaptive
    execution would make one task."""
    base = alloc.where(F.col("m_i") >= 1)
    least = int(alloc.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, math.ceil((base.agg(F.sum("m_i")).first()[0] or 0) / TASK_DRAWS))
    chunks = base.select("i", "a", "m_i", F.explode(F.sequence(
        F.lit(0).cast("bigint"), ((F.col("m_i") - 1) / F.lit(DRAW_CHUNK)).cast("bigint"))).alias("chunk"))
    chunks = chunks.repartition(tasks, "i", "chunk")
    lo = F.col("chunk") * F.lit(DRAW_CHUNK) + F.lit(1)
    hi = F.least(F.col("m_i"), (F.col("chunk") + F.lit(1)) * F.lit(DRAW_CHUNK))
    return chunks.select("i", "a", F.explode(F.sequence(lo, hi)).alias("t"))


def sample_cdf(alloc: DataFrame, cdf: DataFrame, n1: int, n2: int, fro_a: float, fro_b: float,
               seed: int) -> DataFrame:
    """m_i draws with replacement per row from the mixture law, then
    distinct (F3): (i, j).  ``cdf`` is column_cdf of the B norms."""
    return drawn_with_norms(alloc, cdf, n1, n2, fro_a, fro_b, seed).select("i", "j")


def drawn_with_norms(alloc: DataFrame, cdf: DataFrame, n1: int, n2: int, fro_a: float, fro_b: float, seed: int) -> DataFrame:
    """G4 with the norms that a draw has at hand: (i, j, a, b)."""
    d = _draws(alloc, seed)
    ub = uniform(seed, "branch", F.col("i"), F.col("t"))
    uc = uniform(seed, "col", F.col("i"), F.col("t"))
    an = F.col("a") * F.lit(float(n1))
    d = d.withColumn("_unif", ub * (an + F.lit(float(fro_a))) < an).withColumn("_uc", uc)
    # uniform column: equi-join on the column's rank (exactly one match); merged, as draws look as small as their
    # chunks to adaptive execution, which would broadcast them all
    uni = d.where(F.col("_unif")).withColumn("idx", F.floor(F.col("_uc") * F.lit(float(n2))).cast("bigint")) \
        .join(cdf.select("idx", "j", "b").hint("merge"), "idx").select("i", "j", "a", "b")
    # column drawn in proportion to b_j: merged lookup in the shared CDF
    fromcdf = d.where(~F.col("_unif")).withColumn("_x", F.col("_uc") * F.lit(float(fro_b)))
    hit = cdf_lookup(fromcdf.select("i", "a", "_x"), "_x", cdf.select(F.struct("j", "b").alias("_jb"), "lo", "hi"), "_jb", float(fro_b)) \
        .select("i", "_jb.j", "a", "_jb.b")
    return uni.unionByName(hit).dropDuplicates(["i", "j"])


def sample_bernoulli_row(heavy: DataFrame, b_norms: DataFrame, n1: int, n2: int, fro_a: float,
                         fro_b: float, seed: int) -> DataFrame:
    """For a heavy row i, keep column j with probability m_i·q_i(j),
    q_i normalised to 1 (values >= 1 always kept).

    m_i·q_i(j) = x_i + w_i·b_j, drawn by class thinning at every size: no
    pair is enumerated that is not at least half likely to be kept.
    """
    z = F.col("a") / F.lit(float(fro_a)) + F.lit(1.0) / F.lit(float(n1))
    rows = heavy.select(
        "i",
        (F.col("m_i") * F.col("a") / (F.lit(float(n2)) * F.lit(float(fro_a))) / z).alias("x"),
        (F.col("m_i") / (F.lit(float(n1)) * F.lit(float(fro_b))) / z).alias("w"))
    return bernoulli_thinned(rows, b_norms.select("j", "b"), seed, "bern")


def sample_adaptive(a_norms: DataFrame, b_norms: DataFrame, m: float, n1: int, n2: int, fro_a: float,
                    fro_b: float, seed: int, cdf: DataFrame | None = None) -> DataFrame:
    """Heavy rows by G5, the rest by G4; then G3 adds p: (i, j, p)."""
    from pyspark import StorageLevel

    # both are one row per column (n1 and n2 rows) and are read several times
    alloc = row_allocation(a_norms, m, n1, fro_a).persist(StorageLevel.MEMORY_AND_DISK)
    if cdf is None:
        cdf = column_cdf(b_norms)
    cdf = cdf.persist(StorageLevel.MEMORY_AND_DISK)
    heavy = alloc.where(heavy_condition(n2))
    light = alloc.where(~heavy_condition(n2))
    args = (a_norms, b_norms, m, n1, n2, fro_a, fro_b)
    return cell_probability(drawn_with_norms(light, cdf, n1, n2, fro_a, fro_b, seed), *args) \
        .unionByName(cell_probability(sample_bernoulli_row(heavy, b_norms, n1, n2, fro_a, fro_b, seed), *args))


def sample_bernoulli(a_norms: DataFrame, b_norms: DataFrame, m: float, n1: int, n2: int, fro_a: float,
                     fro_b: float, seed: int) -> DataFrame:
    """Every cell kept independently with min(1, p_ij): (i, j, p).

    Drawn by class thinning at every size: work in proportion to the cells
    kept (and n1 times the classes), never to n1·n2.
    """
    rows = a_norms.select("i", (F.col("a") * F.lit(float(m) / (2.0 * n2 * fro_a))).alias("x"),
                          F.lit(float(m) / (2.0 * n1 * fro_b)).alias("w"))
    kept = bernoulli_thinned(rows, b_norms.select("j", "b"), seed, "mask")
    return cell_probability(kept, a_norms, b_norms, m, n1, n2, fro_a, fro_b)


# expected candidates per generator record (bounds the window group size)
THIN_CHUNK = 65536
ZERO_CLASS = 63


def bernoulli_thinned(rows: DataFrame, cols: DataFrame, seed: int, purpose: str = "thin",
                      max_rounds: int = 64) -> DataFrame:
    """Independent Bernoulli(min(1, x_i + w_i·b_j)) for every (i, j) pair,
    without enumerating the pairs.  ``rows`` is (i, x, w), ``cols`` (j, b).

    Columns are grouped into at most 64 classes of b (factor-2 bands below
    the largest b, plus b = 0); class c has n_c columns, ranked 0..n_c-1,
    and a maximum bmax_c.  For row i and class c every column is first a
    candidate with the dominating probability π = min(1, x_i + w_i·bmax_c)
    -- an exact Bernoulli(π) process over the ranks, generated as
    cumulative geometric skips from hashed uniforms -- then accepted with
    p_ij/π >= 1/2.  Work ~ 2·(cells kept) + n1·(classes); a record covers
    at most THIN_CHUNK expected candidates, and records that run out of
    pre-drawn skips continue in another round (no cap).
    """
    from pyspark import StorageLevel

    from rankfold.operators.prefix import prefix_sums

    bmax = cols.agg(F.max("b")).first()[0] or 0.0
    # the number of halvings of the largest b that b is still not above (exact comparisons)
    halves = F.array(*[F.lit(float(bmax) * 0.5 ** s) for s in range(1, ZERO_CLASS)])
    cls = F.when(F.col("b") <= 0, F.lit(ZERO_CLASS)).otherwise(F.size(F.filter(halves, lambda h: F.col("b") <= h)))
    c1 = cols.select("j", "b", cls.alias("c"))
    stats = c1.groupBy("c").agg(F.count(F.lit(1)).alias("n_c"), F.max("b").alias("bmax")).collect()  # <= 64 rows
    stats = sorted((int(r["c"]), int(r["n_c"]), float(r["bmax"])) for r in stats)
    offset, offs = 0, {}
    for c, n_c, _ in stats:
        offs[c] = offset
        offset += n_c
    # rank of each column inside its class: global rank in (class, j) order minus the class offset
    idx = prefix_sums(c1, "j", {"g": F.lit(1).cast("bigint")}).withColumnRenamed("g_lo", "idx")
    ordered = idx.withColumn("ord", F.col("c").cast("bigint") * F.lit(1 << 40) + F.col("idx"))
    ranked = prefix_sums(ordered, "ord", {"q": F.lit(1).cast("bigint")})
    off_col = F.element_at(F.create_map(*[x for c, o in offs.items() for x in (F.lit(c), F.lit(o))]), F.col("c"))
    rank_tab = ranked.select("c", (F.col("q_lo") - off_col).alias("r"), "j", "b") \
        .persist(StorageLevel.MEMORY_AND_DISK)

    classes = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(n).cast("bigint").alias("n_c"),
                                 F.lit(bm).alias("bmax")) for c, n, bm in stats])
    rec = rows.select("i", "x", "w", F.explode(classes).alias("k")).select(
        "i", "x", "w", F.col("k.c").alias("c"), F.col("k.n_c").alias("n_c"),
        F.least(F.lit(1.0), F.col("x") + F.col("w") * F.col("k.bmax")).alias("pbar"))
    rec = rec.where(F.col("pbar") > 0)
    nch = F.greatest(F.lit(1), F.ceil(F.col("n_c") * F.col("pbar") / F.lit(THIN_CHUNK))).cast("bigint")
    rec = rec.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), nch - 1)).alias("ch"), nch.alias("nch"))
    rec = rec.select("i", "x", "w", "c", "ch", "pbar",
                     F.floor(F.col("ch") * F.col("n_c") / F.col("nch")).cast("bigint").alias("lo"),
                     F.floor((F.col("ch") + 1) * F.col("n_c") / F.col("nch")).cast("bigint").alias("hi")) \
        .withColumn("start", F.lit(0).cast("bigint")).withColumn("k0", F.lit(0).cast("bigint"))
    rec = rec.repartition("i", "c", "ch")

    from pyspark.sql import Window

    found = None
    todo = rec
    for _ in range(max_rounds):
        todo = todo.persist(StorageLevel.MEMORY_AND_DISK)
        n_len = F.col("hi") - F.col("lo") - F.col("start")
        expect = n_len * F.col("pbar")
        kdraw = (F.ceil(expect + F.lit(3.0) * F.sqrt(expect)) + 1).cast("bigint")
        d = todo.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), kdraw)).alias("k"))
        u = uniform(seed, purpose + ".skip", F.col("i"), F.col("c"), F.col("ch"), F.col("k0") + F.col("k"))
        skip = F.when(F.col("pbar") >= 1, F.lit(1)).otherwise(
            F.lit(1) + F.floor(F.log(u) / F.log1p(-F.col("pbar")))).cast("bigint")
        w = Window.partitionBy("i", "c", "ch").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("cum", F.col("start") + F.sum(skip).over(w)).persist(StorageLevel.MEMORY_AND_DISK)
        cand = d.where(F.col("cum") <= F.col("hi") - F.col("lo")) \
            .select("i", "x", "w", "c", "pbar", (F.col("lo") + F.col("cum") - 1).alias("r"))
        found = cand if found is None else found.unionByName(cand)
        last = d.groupBy("i", "c", "ch").agg(F.max("cum").alias("last"), F.max("k").alias("kmax"))
        todo_next = todo.join(last, ["i", "c", "ch"]).where(F.col("last") < F.col("hi") - F.col("lo")) \
            .select("i", "x", "w", "c", "ch", "pbar", "lo", "hi", F.col("last").alias("start"),
                    (F.col("k0") + F.col("kmax")).alias("k0"))
        if todo_next.limit(1).count() == 0:
            break
        todo = todo_next
    else:
        raise RuntimeError("bernoulli_thinned did not finish; raise max_rounds")
    hit = found.join(rank_tab, ["c", "r"])
    p = F.least(F.lit(1.0), F.col("x") + F.col("w") * F.col("b"))
    keep = uniform(seed, purpose + ".acc", F.col("i"), F.col("j")) * F.col("pbar") < p
    return hit.where(keep).select("i", "j")


def weights(samples: DataFrame, kind: str = "ones") -> DataFrame:
    """H5: w = 1, or w = 1/min(p, 1)."""
    if kind == "ones":
        return samples.withColumn("w", F.lit(1.0))
    if kind == "inverse_p":
        return samples.withColumn("w", F.lit(1.0) / F.least(F.col("p"), F.lit(1.0)))
    raise ValueError("kind must be 'ones' or 'inverse_p'")
