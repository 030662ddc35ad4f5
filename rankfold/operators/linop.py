"""Implicit product operators and spectral error measures.

M = AᵀB is never formed.  y = M x is two join + aggregate steps over the
cells: w = B x (grouped by row), y = Aᵀ w (grouped by A's column), and
Mᵀ y the same with A and B swapped.  Vectors are DataFrames
``(id, val)``; blocks of r vectors are ``(id, f ARRAY<DOUBLE>)`` and are
summed element-wise with r aggregate columns.  Only scalars (a norm per
round) and r x r matrices reach the driver.

``Operands`` splits the pair once and persists both sides in the
partitioning they already have (never hash-partitioned by row: a row
holding a third of the cells would land in one task).  Each product then
moves only partially aggregated sums of size O(n), never the cells: the
``⋈ x`` becomes a broadcast when AQE sees a small vector at runtime, and
keys holding more than their share of cells are salted (``skew``).  Large
pairs with more rows than columns, where the sums of all rows would be
exchanged in every product, are laid out by blocks of rows (``rowblocks``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.hashing import gaussian
from rankfold.operators.rowblocks import RowBlocks
from rankfold.session import STORE_ROUNDS_FROM, Rounds, ship_package
from rankfold.sources.tables import split

#: Pairs with fewer cells are left to joins.
LAY_OUT_FROM = 1_000_000
#: With at most so many rows, and ``FEW_ROWS_SHARE`` columns to each, a singular value iteration starts from the rows' Gram matrices.
FEW_ROWS = 1024
FEW_ROWS_SHARE = 16


class Operands:
    """A (row, i, a) and B (row, j, b), prepared once for repeated products.

    Hot keys (a row or a column holding more than its share of cells) are
    found once per side and key (bounded lists, see ``skew.hot_keys``);
    every product then salts them, so no task receives a hot key whole.

    ``persist`` says that many products follow.  A pair of ``lay_out_from`` cells and more rows than columns is then laid
    out by blocks of rows when the first one is asked for; its hot rows, which no block should hold whole, stay with
    the joins, and both parts are added.  Only a pair left to joins keeps its sides besides the caller's cells, and only
    for joins are hot columns looked for.
    """

    def __init__(self, cells: DataFrame, partitions: int | None = None, persist: bool = True,
                 detect_skew: bool = True, min_rows: int | None = None, lay_out_from: int = LAY_OUT_FROM):
        from rankfold.operators.skew import DEFAULT_MIN_ROWS

        self.cells, self.lay_out_from, self.min_rows = cells, lay_out_from, min_rows
        self._looked, self._laid, self._rest, self._kept, self.size = False, None, None, False, 0
        a, b = split(cells)
        if partitions:
            # spread by the whole cell key: a hot row is split, not concentrated
            a = a.repartition(partitions, "row", "i")
            b = b.repartition(partitions, "row", "j")
        self.a, self.b = a, b
        self._persisted = persist
        self._least_hot = DEFAULT_MIN_ROWS if min_rows is None else min_rows
        self._hot = None if detect_skew else {"a_row": [], "a_col": [], "b_row": [], "b_col": []}

    @property
    def hot(self) -> dict:
        """Hot rows and columns of both sides."""
        from rankfold.operators.skew import hot_keys_many

        if self._hot is None:
            ha = hot_keys_many(self.a, ["row", "i"], min_rows=self._least_hot)
            hb = hot_keys_many(self.b, ["row", "j"], min_rows=self._least_hot)
            self._hot = {"a_row": ha["row"], "a_col": ha["i"], "b_row": hb["row"], "b_col": hb["j"]}
        return self._hot

    @hot.setter
    def hot(self, found: dict) -> None:
        self._hot = found

    def _hot_rows(self) -> list:
        from rankfold.operators.skew import hot_keys

        if self._hot is not None:
            return sorted({k for s in ("a_row", "b_row") for k, _ in self._hot[s]})
        return sorted({k for side in (self.a, self.b) for k, _ in hot_keys(side, "row", min_rows=self._least_hot)})

    def _keep(self) -> None:
        """The sides stay for joins."""
        if self._persisted and not self._kept:
            self._kept = True
            self.a = self.a.persist(StorageLevel.MEMORY_AND_DISK)
            self.b = self.b.persist(StorageLevel.MEMORY_AND_DISK)

    def join(self, side: str, key: str, other: DataFrame) -> DataFrame:
        """side ⋈ other on key ('row' or the side's column), hot keys salted."""
        from rankfold.operators.skew import salted_join

        big = self.a if side == "a" else self.b
        col = "i" if side == "a" else "j"
        if key == "row":
            return salted_join(big, other, ["row"], "row", self.hot[f"{side}_row"], col)
        return salted_join(big, other, [col], col, self.hot[f"{side}_col"], "row")

    def laid(self) -> RowBlocks | None:
        """The blocks of rows, or None where joins do as well."""
        if self._persisted and not self._looked:
            self._looked = True
            n, rows, columns = self.cells.agg(F.count(F.lit(1)), F.approx_count_distinct("row"), F.approx_count_distinct(F.struct("mat", "col"))).first()
            self.size = n
            if n >= self.lay_out_from and rows > columns:
                hot = self._hot_rows()  # a bounded list
                cells = self.cells
                if hot:
                    self._rest = Operands(cells.where(F.col("row").isin(hot)), persist=False, min_rows=self.min_rows)
                    cells = cells.where(~F.col("row").isin(hot))
                self._laid = RowBlocks(cells)
            else:
                self._keep()
        return self._laid

    def product(self, x: DataFrame, first: str, r: int) -> DataFrame:
        """(id, f[r]) of Aᵀ(Bx), or of Bᵀ(Ax) with ``first`` 'A'; x is (id, f[r])."""
        if (laid := self.laid()) is None:
            side, (inner, outer) = first.lower(), ("j", "i") if first == "B" else ("i", "j")
            other = "a" if side == "b" else "b"
            w = self.join(side, inner, x.select(F.col("id").alias(inner), "f")).groupBy("row").agg(_sum_block(F.col(side), r))
            return self.join(other, "row", w).groupBy(outer).agg(_sum_block(F.col(other), r)).withColumnRenamed(outer, "id")
        y = laid.product(x, first, r)
        if self._rest is None:
            return y
        return y.unionByName(self._rest.product(x, first, r)).groupBy("id").agg(_sum_block(F.lit(1.0), r))

    def a_ids(self) -> DataFrame:
        self.laid()  # what is read often is kept before
        return self.a.select(F.col("i").alias("id")).distinct()

    def b_ids(self) -> DataFrame:
        self.laid()
        return self.b.select(F.col("j").alias("id")).distinct()

    def release(self):
        if self._laid is not None:
            self._laid.release()
        if self._kept:
            self.a.unpersist()
            self.b.unpersist()


# ---------------------------------------------------------------------------
# single vectors (id, val)
# ---------------------------------------------------------------------------

def random_start(ids: DataFrame, seed: int, purpose: str = "start", id_col: str = "id") -> DataFrame:
    """I10 (unnormalised): hashed Gaussian over an id domain."""
    return ids.select(F.col(id_col).cast("bigint").alias("id"),
                      gaussian(seed, purpose, F.col(id_col)).alias("val"))


def norm2(x: DataFrame) -> float:
    r = x.agg(F.sum(F.col("val") * F.col("val")).alias("s")).first()["s"]
    return float(r or 0.0)


def normalize(x: DataFrame) -> DataFrame:
    """X / ‖x‖ (one scalar aggregate, then a projection)."""
    n = math.sqrt(norm2(x))
    return x.select("id", (F.col("val") / F.lit(n if n > 0 else 1.0)).alias("val"))


def dot(x: DataFrame, y: DataFrame) -> DataFrame:
    """E5: one-row (dot)."""
    return x.join(y.withColumnRenamed("val", "_y"), "id").agg(F.sum(F.col("val") * F.col("_y")).alias("dot"))


def axpy(alpha: float, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha·x + y over the union of ids (missing entries are 0)."""
    return x.select("id", (F.col("val") * F.lit(float(alpha))).alias("val")).unionByName(y.select("id", "val")) \
        .groupBy("id").agg(F.sum("val").alias("val"))


def apply_product(ops: Operands, x: DataFrame) -> DataFrame:
    """y = Aᵀ(B x); x over B's columns, y over A's columns."""
    if ops.laid() is not None:
        return ops.product(x.select("id", F.array("val").alias("f")), "B", 1).select("id", F.get("f", 0).alias("val"))
    w = ops.join("b", "j", x.select(F.col("id").alias("j"), F.col("val").alias("x"))) \
        .groupBy("row").agg(F.sum(F.col("b") * F.col("x")).alias("w"))
    return ops.join("a", "row", w).groupBy("i").agg(F.sum(F.col("a") * F.col("w")).alias("val")) \
        .withColumnRenamed("i", "id")


def apply_product_t(ops: Operands, y: DataFrame) -> DataFrame:
    """z = Bᵀ(A y); y over A's columns, z over B's columns."""
    if ops.laid() is not None:
        return ops.product(y.select("id", F.array("val").alias("f")), "A", 1).select("id", F.get("f", 0).alias("val"))
    w = ops.join("a", "i", y.select(F.col("id").alias("i"), F.col("val").alias("y"))) \
        .groupBy("row").agg(F.sum(F.col("a") * F.col("y")).alias("w"))
    return ops.join("b", "row", w).groupBy("j").agg(F.sum(F.col("b") * F.col("w")).alias("val")) \
        .withColumnRenamed("j", "id")


# ---------------------------------------------------------------------------
# blocks of r vectors (id, f ARRAY<DOUBLE>)
# ---------------------------------------------------------------------------

def _sum_block(weight, r: int):
    return F.array(*[F.sum(weight * F.get("f", a)) for a in range(r)]).alias("f")


def apply_product_block(ops: Operands, x: DataFrame, r: int) -> DataFrame:
    return ops.product(x, "B", r)


def apply_product_block_t(ops: Operands, y: DataFrame, r: int) -> DataFrame:
    return ops.product(y, "A", r)


def factor_times(factors: DataFrame, coeffs: list[float]) -> DataFrame:
    """U·c for an r-vector c known on the driver: (id, val)."""
    expr = F.lit(0.0)
    for a, c in enumerate(coeffs):
        expr = expr + F.get("f", a) * F.lit(float(c))
    return factors.select("id", expr.alias("val"))


def factor_t_times(factors: DataFrame, x: DataFrame, r: int) -> list[float]:
    """Uᵀx: r numbers (one aggregate, bounded by r)."""
    row = factors.join(x.withColumnRenamed("val", "_x"), "id").agg(
        *[F.sum(F.get("f", a) * F.col("_x")).alias(f"c{a}") for a in range(r)]).first()
    return [float(row[f"c{a}"] or 0.0) for a in range(r)]


def factor_t_times_norm2(factors: DataFrame, x: DataFrame, r: int) -> tuple[list[float], float]:
    """Uᵀx and ‖x‖² (over all ids of x) by one aggregate."""
    row = x.join(factors, "id", "left").agg(F.sum(F.col("val") * F.col("val")).alias("s"),
                                            *[F.sum(F.get("f", a) * F.col("val")).alias(f"c{a}") for a in range(r)]).first()
    return [float(row[f"c{a}"] or 0.0) for a in range(r)], float(row["s"] or 0.0)


def gram(block: DataFrame, r: int) -> np.ndarray:
    row = block.agg(*[F.sum(F.get("f", a) * F.get("f", b)).alias(f"g{a}_{b}")
                      for a in range(r) for b in range(r)]).first()
    return np.array([[row[f"g{a}_{b}"] or 0.0 for b in range(r)] for a in range(r)], dtype=float)


def block_times(block: DataFrame, mat: np.ndarray) -> DataFrame:
    """X·T for an r x c matrix T on the driver."""
    r, c = mat.shape
    cols = []
    for b in range(c):
        e = F.lit(0.0)
        for a in range(r):
            e = e + F.get("f", a) * F.lit(float(mat[a, b]))
        cols.append(e)
    return block.select("id", F.array(*cols).alias("f"))


# ---------------------------------------------------------------------------
# spectral norms and errors
# ---------------------------------------------------------------------------

def spectral_norm(ops: Operands, iters: int = 5, seed: int = 0, checkpoint: bool = True,
                  tol: float | None = None):
    """Power iteration on MᵀM from a hashed random unit vector.

    Returns (estimate of ‖M‖₂, trace as a list of (round, estimate)).  Each
    round ends with one scalar on the driver.  A few rounds give a lower
    bound of ‖M‖₂; ``tol`` stops early once the relative change of the
    estimate drops below it (``iters`` is then the maximum).
    """
    rounds = Rounds(3 if checkpoint else 10 ** 9)
    x = rounds.keep(random_start(ops.b_ids(), seed, "start"))
    nx = math.sqrt(norm2(x))
    x = x.select("id", (F.col("val") / F.lit(nx if nx > 0 else 1.0)).alias("val"))
    est, trace = 0.0, []
    for k in range(iters):
        z = rounds.keep(apply_product_t(ops, apply_product(ops, x)))
        nz = math.sqrt(norm2(z))
        prev, est = est, math.sqrt(nz)
        trace.append((k + 1, est))
        if tol is not None and prev > 0 and abs(est - prev) <= tol * est:
            break
        x = z.select("id", (F.col("val") / F.lit(nz if nz > 0 else 1.0)).alias("val"))
    return est, trace


def apply_residual(ops: Operands, u: DataFrame, v: DataFrame, x: DataFrame, r: int,
                   vtx: list[float] | None = None) -> DataFrame:
    """(U Vᵀ − M) x, x over B's columns; ``vtx`` is Vᵀx where it is known."""
    approx = factor_times(u, factor_t_times(v, x, r) if vtx is None else vtx)
    exact = apply_product(ops, x)
    return axpy(-1.0, exact, approx)


def apply_residual_t(ops: Operands, u: DataFrame, v: DataFrame, y: DataFrame, r: int) -> DataFrame:
    """I5 transpose: (V Uᵀ − Mᵀ) y, y over A's columns."""
    approx = factor_times(v, factor_t_times(u, y, r))
    exact = apply_product_t(ops, y)
    return axpy(-1.0, exact, approx)


def residual_norm(ops: Operands, u: DataFrame, v: DataFrame, r: int, iters: int = 5, seed: int = 0,
                  checkpoint: bool = True):
    """Power iteration on RᵀR, R = U Vᵀ − M."""
    trace = power_norms(ops, [(u, v)], ["resid"], r, iters, seed, checkpoint)[0]
    return (trace[-1][1] if trace else 0.0), trace


def _side_by_side(factors: list[DataFrame], r: int) -> DataFrame:
    """(id, g[len · r]): the factors of all frames in one array, zeros where a frame lacks the id."""
    tagged = [f.select("id", F.lit(k).alias("k"), "f") for k, f in enumerate(factors)]
    all_of = tagged[0]
    for t in tagged[1:]:
        all_of = all_of.unionByName(t)
    none = F.array_repeat(F.lit(0.0), r)
    return all_of.groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col("f"))).alias(f"f{k}") for k in range(len(factors))]) \
        .select("id", F.concat(*[F.coalesce(f"f{k}", none) for k in range(len(factors))]).alias("g"))


def _with_factors(exact: DataFrame, factors: DataFrame | None, c: list, m: int, width: int) -> DataFrame:
    """(id, f[m], g[width]): approximation less product, and beside it the factors ``g`` of its ids, so that the next
    step's sums need no join.  ``c[k]``: (place in g, coefficient) of column k's approximation."""
    sums = [F.sum(F.get("f", k)) for k in range(m)]
    minus = exact.select("id", F.transform("f", lambda e: -e).alias("f"))
    if factors is None:
        return minus.groupBy("id").agg(F.array(*sums).alias("f")).withColumn("g", F.array().cast("array<double>"))
    approx = F.array(*[sum((F.get("g", at) * F.lit(float(x)) for at, x in c[k]), F.lit(0.0)) for k in range(m)])
    both = minus.withColumn("g", F.lit(None).cast("array<double>")).unionByName(factors.select("id", approx.alias("f"), "g"))
    return both.groupBy("id").agg(F.array(*sums).alias("f"), F.array(*[F.coalesce(F.sum(F.get("g", k)), F.lit(0.0)) for k in range(width)]).alias("g"))


def power_norms(ops: Operands, pairs: list, purposes: list[str], r: int, iters: int = 5, seed: int = 0,
                checkpoint: bool = True) -> list[list]:
    """Power iteration on RᵀR for several R = U Vᵀ − M at a time, a column of the vectors for each, so that all share the
    products with M; ``None`` for a pair is M itself.  ``purposes`` names the columns' random starts.  Returns a trace, a
    list of (round, estimate of ‖R‖₂), for each."""
    m, real = len(pairs), [k for k, p in enumerate(pairs) if p is not None]
    width = len(real) * r
    places = {k: range(n * r, n * r + r) for n, k in enumerate(real)}
    ops.laid()
    rounds = Rounds((1 if ops.size >= STORE_ROUNDS_FROM else 4) if checkpoint else 10 ** 9)
    us, vs = (_side_by_side([pairs[k][side] for k in real], r).persist(StorageLevel.MEMORY_AND_DISK) if real else None for side in (0, 1))

    def told(x: DataFrame) -> tuple[list, np.ndarray]:
        """Fᵀx of each pair, as (place, number), and ‖x‖, by one aggregate."""
        row = x.agg(*[F.sum(F.get("f", k) * F.get("f", k)).alias(f"s{k}") for k in range(m)],
                    *[F.sum(F.get("g", at) * F.get("f", k)).alias(f"c{at}") for k in real for at in places[k]]).first()
        return [[(at, float(row[f"c{at}"] or 0.0)) for at in places.get(k, ())] for k in range(m)], np.sqrt([float(row[f"s{k}"] or 0.0) for k in range(m)])

    ids = ops.b_ids()
    start = ids.select(F.col("id").cast("bigint").alias("id"), F.array(*[-gaussian(seed, p, F.col("id")) for p in purposes]).alias("f"))
    x = rounds.keep(_with_factors(start, vs, [[]] * m, m, width))
    traces: list[list] = [[] for _ in pairs]
    for k in range(iters + 1):
        c, n = told(x)  # a round's norms and the next one's Vᵀx
        if k:
            for trace, e in zip(traces, n):
                trace.append((k, math.sqrt(e)))
        if k == iters:
            break
        n = np.where(n > 0, n, 1.0)
        x = x.select("id", F.array(*[F.get("f", a) / F.lit(float(n[a])) for a in range(m)]).alias("f"))
        y = rounds.keep(_with_factors(ops.product(x, "B", m), us, [[(at, v / n[a]) for at, v in c[a]] for a in range(m)], m, width))
        x = rounds.keep(_with_factors(ops.product(y.select("id", "f"), "A", m), vs, told(y)[0] if real else [[]] * m, m, width))
    rounds.release()
    for side in (us, vs):
        if side is not None:
            side.unpersist()
    return traces


def residual_norms(ops: Operands, pairs: list[tuple[DataFrame, DataFrame]], r: int, iters: int = 5, seed: int = 0,
                   checkpoint: bool = True) -> list[float]:
    """I7 of several pairs (U, V) at a time: the rounds of :func:`residual_norm` with a column for each pair, so that
    all pairs share the products with M."""
    traces = power_norms(ops, pairs, ["resid"] * len(pairs), r, iters, seed, checkpoint)
    return [t[-1][1] if t else 0.0 for t in traces]


def relative_error(ops: Operands, u: DataFrame, v: DataFrame, r: int, iters: int = 5, seed: int = 0) -> dict:
    """I8: ‖UVᵀ − M‖₂ / ‖M‖₂, both by ``iters`` power rounds, which share the products with M."""
    t1, t2 = power_norms(ops, [None, (u, v)], ["start", "resid"], r, iters, seed)
    top, res = (t[-1][1] if t else 0.0 for t in (t1, t2))
    return {"norm": top, "residual": res, "rel_error": res / top if top > 0 else float("nan"),
            "norm_trace": t1, "residual_trace": t2}


def svd(ops: Operands, r: int, iters: int = 60, seed: int = 0, tol: float = 1e-7, oversample: int = 5,
        checkpoint: bool = True) -> dict:
    """H8: top-r singular triplets of M by block subspace iteration.

    The block has ``oversample`` more columns than asked for.  Each round:
    Y = M V = Q R with Q orthonormal (two passes), the SVD of the small R
    rotates both sides onto the current singular vectors (Rayleigh-Ritz),
    V = orthonormal basis of Mᵀ Q.  After that rotation the columns come in
    falling size, so small singular values are not swamped by large ones.
    Directions lost to rounding are replaced by fresh random ones.  A pair
    with few rows for its columns starts from :func:`start_from_rows` and
    needs a few rounds only, others from random vectors.  Stops
    when no wanted σ moves by more than ``tol`` of itself (σ below 1e-13 of
    the largest count as zero).

    Returns {'sigmas', 'u', 'v', 'converged', 'rounds'}.
    """
    rounds = Rounds(4 if checkpoint else 10 ** 9)
    q = max(1, min(int(r) + int(oversample), ops.a_ids().count(), ops.b_ids().count()))
    start = start_from_rows(ops, q, seed, rounds)
    v, _ = orthonormalize(rounds.keep(random_start_block(ops.b_ids(), q, seed)) if start is None else start, q)
    v, prev, converged, k = rounds.keep(v), None, False, 0
    for k in range(1, int(iters) + 1):
        y, root = orthonormalize(rounds.keep(apply_product_block(ops, v, q)), q)
        left, sig, right = np.linalg.svd(root)
        sig = np.where(sig > 1e-13 * sig[0], sig, 0.0) if sig[0] > 0 else sig
        u = rounds.keep(block_times(y, left))
        now = sig[:r]
        converged = prev is not None and bool(np.all(np.abs(now - prev) <= tol * np.maximum(now, 1e-13 * max(sig[0], 1e-300))))
        if converged or k == iters or sig[0] == 0:
            converged = converged or sig[0] == 0
            break
        prev = now
        z, back = orthonormalize(rounds.keep(apply_product_block_t(ops, u, q)), q)
        v = refill(rounds.keep(z), q, [a for a in range(q) if back[a, a] == 0], seed, k, rounds)
    take = min(int(r), q)
    nonzero = np.where(sig[:take] > 0, 1.0, 0.0)
    return {"sigmas": [float(x) for x in sig[:take]] + [0.0] * (int(r) - take),
            "u": block_times(u, np.eye(q)[:, :take] * nonzero), "v": block_times(v, right.T[:, :take]),
            "converged": converged, "rounds": k}


def svd_exact(ops: Operands, r: int, iters: int = 60, seed: int = 0, checkpoint: bool = True, tol: float = 1e-7):
    """H8: (sigmas, U, V) of :func:`svd`; an error if ``iters`` rounds do not
    reach ``tol``."""
    got = svd(ops, r, iters, seed, tol, checkpoint=checkpoint)
    if not got["converged"]:
        raise RuntimeError(f"singular values still move by more than {tol} after {iters} rounds; raise iters or tol")
    return got["sigmas"], got["u"], got["v"]


def random_start_block(ids: DataFrame, r: int, seed: int) -> DataFrame:
    return ids.select(F.col("id").cast("bigint").alias("id"),
                      F.array(*[gaussian(seed, "block", F.col("id"), F.lit(a)) for a in range(r)]).alias("f"))


def _gram_batches(rows: list[int], col: str, value: str):
    """Rows (k, g[d]) of the sum of x xᵀ over a task's columns x, given as lists of cells."""
    def run(batches):
        known, g = np.array(rows, dtype=np.int64), np.zeros((len(rows), len(rows)))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                cells = b.column("cells").slice(lo, 1000)
                x = np.zeros((len(cells), len(known)))
                flat = cells.flatten()
                of = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
                x[of, np.searchsorted(known, flat.field("row").to_numpy())] = flat.field(value).to_numpy()
                g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], names=["k", "g"])
    return run


def _added(t: pa.Table) -> pa.Table:
    g = t.column("g").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).sum(axis=0)
    return pa.table({"k": t.column("k").slice(0, 1), "g": pa.array([g], pa.list_(pa.float64()))})


def row_gram(side: DataFrame, col: str, value: str, rows: list[int]) -> np.ndarray:
    """X Xᵀ of a side whose rows are ``rows`` (ascending, at most FEW_ROWS); a column is a list of so many cells at most."""
    ship_package(side.sparkSession)
    columns = side.groupBy(col).agg(F.collect_list(F.struct("row", value)).alias("cells")).select("cells")
    parts = columns.mapInArrow(_gram_batches(rows, col, value), "k int, g array<double>").groupBy("k").applyInArrow(_added, "k int, g array<double>")
    out = np.zeros((len(rows), len(rows)))
    for r in parts.collect():
        out[r["k"]] = r["g"]
    return out


def start_from_rows(ops: Operands, q: int, seed: int, rounds: Rounds) -> DataFrame | None:
    """The first q right singular vectors of M as far as the Gram matrices of its rows tell them; None unless there are
    at most FEW_ROWS rows and FEW_ROWS_SHARE columns to each.

    With A Aᵀ = C Cᵀ and B Bᵀ = D Dᵀ the singular values of AᵀB are those of CᵀD, and a right singular vector q of CᵀD
    gives Bᵀ D⁺ᵀ q.  Squares lose half the digits, so this is where an iteration starts, not its result.
    """
    few = ops.a.select("row").union(ops.b.select("row")).distinct().limit(FEW_ROWS + 1).collect()
    if len(few) > FEW_ROWS or ops.a_ids().count() + ops.b_ids().count() < FEW_ROWS_SHARE * len(few):
        return None
    rows = sorted(r["row"] for r in few)
    roots = []
    for side, col, value in ((ops.a, "i", "a"), (ops.b, "j", "b")):
        size, axes = np.linalg.eigh(row_gram(side, col, value, rows))
        roots.append(axes * np.sqrt(np.maximum(size, 0.0)))
    _, sigma, right = np.linalg.svd(roots[0].T @ roots[1])
    told = min(q, int((sigma > 1e-7 * sigma[0]).sum())) if sigma[0] > 0 else 0
    t = np.zeros((len(rows), q))
    t[:, :told] = np.linalg.pinv(roots[1].T, rcond=1e-7) @ right.T[:, :told]
    w = ops.a.sparkSession.createDataFrame([(r, x.tolist()) for r, x in zip(rows, t)], "row bigint, f array<double>")
    v = rounds.keep(ops.join("b", "row", w).groupBy("j").agg(_sum_block(F.col("b"), q)).withColumnRenamed("j", "id"))
    return refill(v, q, list(range(told, q)), seed, 0, rounds)


def _orthonormal_factor(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """T and R with X T orthonormal and X = (X T) R, from G = XᵀX, and the
    smallest share of a column that was new.

    Columns are scaled to length one and taken in falling size (Cholesky of
    a graded matrix); one that depends on those before it gives a zero column.
    """
    n = len(g)
    d = np.sqrt(np.maximum(np.diag(g), 0.0))
    order = np.argsort(-d, kind="stable")
    live = d > 1e-14 * (d.max() if n else 0.0)
    safe = np.where(live, d, 1.0)
    c = g / safe[:, None] / safe[None, :]
    t, root, least = np.zeros((n, n)), np.zeros((n, n)), 1.0
    basis: list[int] = []
    for j in order:
        if not live[j]:
            continue
        column = np.zeros(n)
        column[j] = 1.0
        for b in basis:
            x = t[:, b] @ c[:, j]  # coefficient on the basis so far
            column -= x * t[:, b]
            root[b, j] = x * d[j]
        left = column @ c @ column
        if left > 1e-13:
            t[:, j] = column / math.sqrt(left)
            root[j, j] = math.sqrt(left) * d[j]
            least = min(least, left)
            basis.append(j)
    return t / safe[:, None], root, least


def orthonormalize(block: DataFrame, r: int) -> tuple[DataFrame, np.ndarray]:
    """(Q, R) with X = Q R and orthonormal (or zero) columns of Q, by r x r
    Gram matrices; a second pass takes away the rounding that columns close
    to each other leave."""
    t1, r1, least = _orthonormal_factor(gram(block, r))
    once = block_times(block, t1)
    if least > 0.1:
        return once, r1
    t2, r2, _ = _orthonormal_factor(gram(once, r))
    return block_times(once, t2), r2 @ r1


def refill(block: DataFrame, r: int, gone: list[int], seed: int, turn: int, rounds: Rounds) -> DataFrame:
    """Put fresh random columns, orthonormal to the others, in the place of
    the zero columns ``gone``."""
    if not gone:
        return block
    cols = [gaussian(seed, "refill", F.col("id"), F.lit(turn * r + a)) * F.lit(1e-3) if a in gone else F.get("f", a) for a in range(r)]
    mixed = rounds.keep(block.select("id", F.array(*cols).alias("f")))
    return rounds.keep(orthonormalize(mixed, r)[0])


def optimal_error(ops: Operands, r: int, iters: int = 60, seed: int = 0, tol: float = 1e-7) -> dict:
    """σ_{r+1}/σ₁, the error of the best rank-r approximation."""
    sig, _, _ = svd_exact(ops, r + 1, iters, seed, tol=tol)
    return {"sigmas": sig, "opt_error": sig[r] / sig[0] if sig and sig[0] > 0 else float("nan")}
