"""The two ready-made jobs and the method comparison.

Every step is a DataFrame operator; the driver only sees scalars (totals,
the sample budget, one norm per power round) and r x r matrices.  Lineage
is cut with reliable checkpoints in the session's checkpoint folder at the
points a recomputation would be expensive (samples, observed cells, every
ALS half-step and power round).
"""

from __future__ import annotations

import math
import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.operators import factorize as FZ
from rankfold.operators import linop as L
from rankfold.operators import norms as N
from rankfold.operators import product as P
from rankfold.operators import sampling as S
from rankfold.operators import sketch as K
from rankfold.operators.prefix import column_cdf
from rankfold.session import cut_lineage, ensure_checkpoint_dir, ship_package

REPORT_SCHEMA = "metric string, round int, value double"


def _report(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([(m, int(r), float(v)) for m, r, v in rows], REPORT_SCHEMA)


def _sample(norms: DataFrame, rank: int, ss: float, seed: int):
    tot = N.norm_totals(norms)
    bud = S.sample_budget(tot["n1"], tot["n2"], rank, ss)
    a_n, b_n = S.a_side(norms), S.b_side(norms)
    cdf = column_cdf(b_n)
    samples = S.sample_adaptive(a_n, b_n, bud["m"], tot["n1"], tot["n2"], tot["fro_a"], tot["fro_b"], seed, cdf)
    return cut_lineage(samples), tot, bud


def _factorize(observed: DataFrame, norms: DataFrame, rank: int, iters: int, lam: float, seed: int,
               solver: str):
    if solver == "wals":
        v_ids = norms.where(F.col("mat") == "B").select(F.col("col").alias("id"))
        return FZ.wals(observed, v_ids, rank, iters, lam, seed)
    if solver == "mllib":
        if lam <= 0:
            raise ValueError("solver 'mllib' needs lam > 0")
        return FZ.factorize_als(observed, rank, iters, lam, seed)
    raise ValueError("solver must be 'wals' or 'mllib'")


def _errors(spark, cells, u, v, rank, power_iters, seed, partitions):
    ops = L.Operands(cells, partitions)
    try:
        err = L.relative_error(ops, u, v, rank, power_iters, seed)
    finally:
        ops.release()
    rows = [("norm", k, x) for k, x in err["norm_trace"]]
    rows += [("residual", k, x) for k, x in err["residual_trace"]]
    rows.append(("rel_error", 0, err["rel_error"]))
    return rows


def _estimator_error(observed: DataFrame, norms: DataFrame, k: int) -> list:
    """What a sketch of size k can tell: the root mean square of the values on
    the sampled cells, and of the estimator's own spread ‖aᵢ‖‖bⱼ‖/√k there.
    Where the spread is not well below the values, the answer is noise and k
    must grow."""
    got = observed.join(S.a_side(norms), "i").join(S.b_side(norms), "j").agg(
        F.sqrt(F.avg(F.col("val") * F.col("val"))).alias("v"), F.sqrt(F.avg(F.col("a") * F.col("b")) / F.lit(float(k))).alias("e")).first()
    return [("value_rms", 0, float(got["v"] or 0.0)), ("estimator_spread", 0, float(got["e"] or 0.0))]


def _signal(estimator_error: list) -> tuple[float, float]:
    """The size of the values without the estimator's spread (0 where it can't
    be told from the spread), and the spread."""
    (_, _, value), (_, _, spread) = estimator_error
    left = value * value - spread * spread
    return (math.sqrt(left) if left > 0.2 * spread * spread else 0.0), spread


def next_size(estimator_error: list, k: int, share: float, limit: int) -> int | None:
    """The sketch size at which the spread, which falls as 1/√k, is ``share``
    of the values; None where ``k`` is enough.  At least twice ``k``, and four
    times where nothing but spread is seen; an error beyond ``limit``."""
    signal, spread = _signal(estimator_error)
    if spread <= share * signal:
        return None
    if k >= limit:
        raise ValueError(f"a sketch of {k} coordinates leaves a spread of {spread:.3g} on values of {signal:.3g}, and {limit} is the "
                         "most allowed: raise k_max, or take two_pass_factorize")
    wanted = math.ceil(k * (spread / (share * signal)) ** 2) if signal > 0 else 4 * k
    return min(limit, max(2 * k, wanted))


def _warn_of_noise(rows: list, estimator_error: list, k: int) -> None:
    """Factors of noise are not returned in silence."""
    signal, spread = _signal(estimator_error)
    if spread > signal:
        warnings.warn(f"one-pass values are mostly noise at k = {k}: spread {spread:.3g}, values {signal:.3g}; let the sketch grow "
                      "(share) or take two_pass_factorize", stacklevel=3)
    error = [v for m, _, v in rows if m == "rel_error"]
    if error and error[0] > 1:
        warnings.warn(f"relative error {error[0]:.3g}: zero factors would be closer", stacklevel=3)


def two_pass_factorize(spark: SparkSession, cells: DataFrame, rank: int = 5, iters: int = 10,
                       lam: float = 0.0, ss: float = 2.0, seed: int = 0, power_iters: int = 5,
                       weight: str = "ones", solver: str = "wals", evaluate: bool = True,
                       partitions: int | None = None, stored: bool = False, by_row: bool = False) -> dict:
    """Norms (pass 1) -> sample -> exact sampled values (pass 2) -> ALS
    -> spectral error.  Returns {'u', 'v', 'observed', 'report'}.

    ``stored``: the cells lie in files and need not be kept besides; ``by_row``: these are buckets of the cells' row."""
    cells = cells if stored else cells.persist(StorageLevel.MEMORY_AND_DISK)
    norms = cut_lineage(N.col_norms2(cells))
    samples, tot, bud = _sample(norms, rank, ss, seed)
    observed = S.weights(P.value_exact(cells, samples, "auto", columns=norms, by_row=by_row), weight)
    observed = cut_lineage(observed)
    u, v = _factorize(observed, norms, rank, iters, lam, seed, solver)
    rows = [("n1", 0, tot["n1"]), ("n2", 0, tot["n2"]), ("budget", 0, bud["m"]),
            ("samples", 0, observed.count())]
    if evaluate:
        rows += _errors(spark, cells, u, v, rank, power_iters, seed, partitions)
    return {"u": u, "v": v, "observed": observed, "report": _report(spark, rows), "norms": norms}


def one_pass_factorize(spark: SparkSession, cells: DataFrame, rank: int = 5, k: int = 64,
                       iters: int = 10, lam: float = 0.0, ss: float = 2.0, seed: int = 0,
                       power_iters: int = 5, estimator: str = "rescaled", sketch: str = "srht",
                       n_rows: int | None = None, weight: str = "ones", solver: str = "wals",
                       evaluate: bool = True, partitions: int | None = None, share: float | None = None,
                       k_max: int | None = None, stored: bool = False) -> dict:
    """ONE scan builds sketches and exact norms together; samples are
    valued from the sketches alone.  ``n_rows`` (the row-id bound) fixes
    the padded length; if omitted it is read from the cells (a second,
    row-column-only scan).  Evaluation re-reads the data by design.

    With ``share`` (SRHT only) the sketch grows until the estimator's spread
    is at most that share of the values on the sampled cells: further scans
    append coordinates to those there are.  ``k_max`` (and half the padded
    length) ends this with an error.  Without it ``k`` stays, and values that
    are mostly noise make a warning.  ``stored``: the cells lie in files and
    are not kept besides for the evaluation."""
    if share is not None and (sketch != "srht" or share <= 0):
        raise ValueError("share is a positive number and needs the srht sketch")
    if sketch == "srht":
        if n_rows is None:
            n_rows = int(cells.agg(F.max("row")).first()[0]) + 1
        n = K.padded_length(n_rows)
        coords = K.pick_coords(seed, n, k)
        wide = cut_lineage(K.srht_sketch_wide(cells, coords, seed, n))
        norms = wide.select("mat", "col", "norm2")
    elif sketch == "gaussian":
        long = K.gaussian_sketch_cells(cells, k, seed, with_norms=True).persist(StorageLevel.MEMORY_AND_DISK)
        norms = long.where(F.col("t") < 0).select("mat", "col", F.col("s").alias("norm2"))
        norms = cut_lineage(norms)
        wide = cut_lineage(K.sketch_wide(long, k))
    else:
        raise ValueError("sketch must be 'srht' or 'gaussian'")
    samples, tot, bud = _sample(norms, rank, ss, seed)

    def valued() -> DataFrame:
        return cut_lineage(S.weights(K.value_from_sketch(samples, wide, norms, estimator), weight))

    observed = valued()
    spread = _estimator_error(observed, norms, k)
    if share is not None:
        limit = max(1, min(k_max or n, (n - 1) // 2))  # from half the length on, coordinates are picked anew
        while (more := next_size(spread, k, share, limit)) is not None:
            wide = cut_lineage(K.append_coords(wide, cells, K.pick_coords(seed, n, more), k, seed, n))
            k = more
            observed = valued()
            spread = _estimator_error(observed, norms, k)
    u, v = _factorize(observed, norms, rank, iters, lam, seed, solver)
    rows = [("n1", 0, tot["n1"]), ("n2", 0, tot["n2"]), ("budget", 0, bud["m"]),
            ("samples", 0, observed.count()), ("k", 0, k)]
    rows += spread
    if evaluate:
        cells = cells if stored else cells.persist(StorageLevel.MEMORY_AND_DISK)
        rows += _errors(spark, cells, u, v, rank, power_iters, seed, partitions)
    _warn_of_noise(rows, spread, k)
    return {"u": u, "v": v, "observed": observed, "report": _report(spark, rows), "norms": norms,
            "sketch": wide}


def one_pass_factorize_vecs(spark: SparkSession, vecs: DataFrame, d: int, rank: int = 5, k: int = 64,
                            iters: int = 10, lam: float = 0.0, ss: float = 2.0, seed: int = 0,
                            estimator: str = "rescaled", weight: str = "ones", cells: DataFrame | None = None,
                            power_iters: int = 5) -> dict:
    """P2 on column-grouped input (mat, col, vec[d]): sketches and norms in
    one projection with the fast transform, no shuffle.  ``cells`` (the same
    data as cells) is only read to evaluate the error."""
    n = K.padded_length(d)
    coords = K.pick_coords(seed, n, k)
    sk = cut_lineage(K.srht_sketch_vecs(vecs, d, coords, seed))
    norms = sk.select("mat", "col", "norm2")
    samples, tot, bud = _sample(norms, rank, ss, seed)
    observed = cut_lineage(S.weights(K.value_from_sketch(samples, sk, norms, estimator), weight), cache=True)
    v_ids = norms.where(F.col("mat") == "B").select(F.col("col").alias("id"))
    u, v = FZ.wals(observed, v_ids, rank, iters, lam, seed)
    rows = [("n1", 0, tot["n1"]), ("n2", 0, tot["n2"]), ("budget", 0, bud["m"]),
            ("samples", 0, observed.count())]
    spread = _estimator_error(observed, norms, k)
    rows += [("k", 0, k), *spread]
    if cells is not None:
        rows += _errors(spark, cells, u, v, rank, power_iters, seed, None)
    _warn_of_noise(rows, spread, k)
    return {"u": u, "v": v, "observed": observed, "norms": norms, "sketch": sk,
            "report": _report(spark, rows)}


def two_pass_factorize_vecs(spark: SparkSession, vecs: DataFrame, rank: int = 5, iters: int = 10,
                            lam: float = 0.0, ss: float = 2.0, seed: int = 0, weight: str = "ones",
                            cells: DataFrame | None = None, power_iters: int = 5) -> dict:
    """P1 on column-grouped (dense) input: norms in one projection (pass 1),
    exact sampled values as array dot products (pass 2)."""
    vecs = vecs.persist(StorageLevel.MEMORY_AND_DISK)
    norms = cut_lineage(N.col_norms2_vecs(vecs))
    samples, tot, bud = _sample(norms, rank, ss, seed)
    observed = cut_lineage(S.weights(P.value_exact_vecs(vecs, samples), weight), cache=True)
    v_ids = norms.where(F.col("mat") == "B").select(F.col("col").alias("id"))
    u, v = FZ.wals(observed, v_ids, rank, iters, lam, seed)
    rows = [("n1", 0, tot["n1"]), ("n2", 0, tot["n2"]), ("budget", 0, bud["m"]),
            ("samples", 0, observed.count())]
    if cells is not None:
        rows += _errors(spark, cells, u, v, rank, power_iters, seed, None)
    vecs.unpersist()
    return {"u": u, "v": v, "observed": observed, "norms": norms, "report": _report(spark, rows)}


def synthetic_benchmark(spark: SparkSession, n: int, d: int, rank: int = 5, k: int = 64, iters: int = 10,
                        ss: float = 2.0, seed: int = 0, power_iters: int = 5, svd_iters: int = 60, svd_tol: float = 1e-4,
                        timer=None) -> DataFrame:
    """The reference's published experiment at a chosen size: A, B = D·G
    (d x n, D_ii = 1/i), best rank-r error vs two-pass vs one-pass, with
    wall-clock seconds.  Returns (method, rel_error, seconds)."""
    import time

    from rankfold.sources.generate import decay_matrix, decay_vecs_direct

    cells = decay_matrix(spark, d, n, 1.0, seed).persist(StorageLevel.MEMORY_AND_DISK)
    vecs = decay_vecs_direct(spark, d, n, 1.0, seed)
    out = []
    t0 = time.time()
    ops = L.Operands(cells)
    try:
        sig, _, _ = L.svd_exact(ops, rank + 1, svd_iters, seed, tol=svd_tol)
    finally:
        ops.release()
    out.append(("optimal", sig[rank] / sig[0], time.time() - t0))
    for name, fn in (("two_pass", lambda: two_pass_factorize_vecs(
            spark, vecs, rank, iters, 0.0, ss, seed, cells=cells, power_iters=power_iters)),
            ("one_pass", lambda: one_pass_factorize_vecs(
                spark, vecs, d, rank, k, iters, 0.0, ss, seed, cells=cells, power_iters=power_iters))):
        t0 = time.time()
        rep = {r["metric"]: r["value"] for r in fn()["report"].collect() if r["round"] == 0}
        out.append((name, rep["rel_error"], time.time() - t0))
    cells.unpersist()
    return spark.createDataFrame([(m, float(e), float(t)) for m, e, t in out],
                                 "method string, rel_error double, seconds double")


def compare_methods(spark: SparkSession, cells: DataFrame, rank: int = 2, k: int = 64, iters: int = 10,
                    lam: float = 0.0, ss: float = 2.0, seed: int = 0, power_iters: int = 5,
                    svd_iters: int = 60, svd_tol: float = 1e-4) -> DataFrame:
    """Best rank-r error, one-pass (Gaussian sketch, rescaled values)
    and two-pass (exact values) on the SAME Bernoulli mask, all relative to
    σ₁.  Returns (method, rel_error).

    The three are chains of many small jobs that don't wait for one another's
    results, so each is driven by a thread of its own; both residuals
    share one power iteration."""
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    ops = L.Operands(cells)
    try:
        ops.laid()  # looked up once, before several threads ask
        with ThreadPoolExecutor(3) as pool:
            aside = lambda f: pool.submit(inheritable_thread_target(spark)(f))
            best = aside(lambda: L.svd_exact(ops, rank + 1, svd_iters, seed, tol=svd_tol)[0])
            sketched = aside(lambda: cut_lineage(K.sketch_wide(K.gaussian_sketch_cells(cells, k, seed), k)))
            norms = N.col_norms2(cells).persist(StorageLevel.MEMORY_AND_DISK)
            tot = N.norm_totals(norms)
            bud = S.sample_budget(tot["n1"], tot["n2"], rank, ss)
            a_n, b_n = S.a_side(norms), S.b_side(norms)
            mask = cut_lineage(S.sample_bernoulli(a_n, b_n, bud["m"], tot["n1"], tot["n2"], tot["fro_a"],
                                                  tot["fro_b"], seed))
            v_ids = b_n.select(F.col("j").alias("id"))

            def factors(values):
                obs = cut_lineage(S.weights(values(), "ones"), cache=True)
                return FZ.wals(obs, v_ids, rank, iters, lam, seed)

            wide = sketched.result()
            pairs = [aside(lambda: factors(lambda: K.value_from_sketch(mask, wide, norms, "rescaled"))),
                     aside(lambda: factors(lambda: P.value_exact(cells, mask, "auto")))]
            left = L.residual_norms(ops, [p.result() for p in pairs], rank, power_iters, seed)
            sig = best.result()
        s1 = sig[0]
        out = [(m, e / s1 if s1 > 0 else float("nan")) for m, e in zip(("optimal", "one_pass", "two_pass"), [sig[rank], *left])]
    finally:
        ops.release()
    return spark.createDataFrame(out, "method string, rel_error double")
