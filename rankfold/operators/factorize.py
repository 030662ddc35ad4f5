"""Matrix completion of the sampled cells: weighted ALS and helpers (H1-H7).

Factor frames are ``(id BIGINT, f ARRAY<DOUBLE>)`` of length r.

A weighted ALS half-step solves, for every row i independently,
    min_u  sum_j w_ij (val_ij - u·v_j)^2 + λ‖u‖²
i.e. (Σ w v vᵀ + λI) u = Σ w val v.

The observed cells are blocked once by i and once by j (:func:`blocks`) and stay where they are for all rounds.  A
routing table names the blocks that use a factor, and a half-step ships each factor to those blocks only, where numpy
forms the r x r sums of every row.  A row with many samples is spread over several blocks, whose sums are then added.
Singular systems (λ = 0 and fewer than r samples) get the least-norm solution.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.hashing import gaussian
from rankfold.session import STORE_ROUNDS_FROM, Rounds, ensure_checkpoint_dir, freed_shuffles, ship_package

FACTOR_SCHEMA = "id bigint, f array<double>"


#: Cells of a block, about; one task holds one block at a time.
BLOCK_CELLS = 500_000


@dataclass
class Blocks:
    """``cells``: (block, i, j, val, w), bucketed by block; ``routes``: (id, to), the blocks that use a factor of the other side, bucketed by id; ``split``: some row lies in
    several blocks."""

    cells: DataFrame
    routes: DataFrame
    split: bool

    names: tuple[str, str]

    def release(self) -> None:
        """Forget the tables; their files stay in the checkpoint folder for frames that still read them."""
        for name in self.names:
            self.cells.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def blocks(observed: DataFrame, own: str = "i", other: str = "j", block_cells: int = BLOCK_CELLS) -> Blocks:
    """The observed cells by blocks of ``own``, with the routing table of the factors of ``other``.

    A row with more than half a block's cells is dealt to several blocks by a hash of ``other``.
    """
    from rankfold.operators.skew import hot_keys, salt_table

    cells = observed.select(F.col(own).cast("bigint").alias("i"), F.col(other).cast("bigint").alias("j"),
                            F.col("val").cast("double").alias("val"), F.col("w").cast("double").alias("w"))
    least = int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, math.ceil(observed.count() / block_cells))
    hot = hot_keys(cells, "i", n, max(1, block_cells // 2))
    spread = F.lit(0).cast("bigint")
    if hot:  # at most one row per block
        cells = cells.join(F.broadcast(salt_table(observed.sparkSession, "i", hot)), "i", "left")
        spread = F.coalesce(F.pmod(F.xxhash64("j"), F.col("_nsalt")), F.lit(0)).cast("bigint")
    cells = cells.withColumn("block", F.pmod(F.xxhash64("i") + spread, F.lit(n)).cast("int")).select("block", "i", "j", "val", "w")
    cells, c_name = bucketed(cells, "block", n)
    routes, r_name = bucketed(cells.select(F.col("j").alias("id"), F.col("block").alias("to")).distinct(), "id", n)
    return Blocks(cells, routes, bool(hot), (c_name, r_name))


def bucketed(df: DataFrame, key: str, n: int, dealt: bool = False) -> tuple[DataFrame, str]:
    """``df`` written below the checkpoint folder in n buckets of ``key``: later steps find it lying by that key.
    ``dealt``: it lies in n partitions of ``key`` already.

    A persisted or checkpointed frame would not do, as adaptive execution forgets how it is partitioned.
    """
    spark = df.sparkSession
    name = f"rankfold_{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("compression", "zstd") \
            .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def _solved(ids: np.ndarray, g: np.ndarray, h: np.ndarray, lam: float) -> pa.Table:
    """Factors from the sums g (n, r, r) and h (n, r)."""
    r = h.shape[1]
    if r == 1:
        den = g[:, 0, 0] + lam
        x = np.where(den != 0, h[:, 0] / np.where(den != 0, den, 1.0), 0.0)[:, None]
    else:
        x = np.einsum("nij,nj->ni", np.linalg.pinv(g + lam * np.eye(r)[None], hermitian=True), h) if len(ids) else h
    return pa.table({"id": pa.array(ids, pa.int64()), "f": _lists(x)})


def _lists(rows: np.ndarray) -> pa.Array:
    n, r = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * r), pa.array(rows.ravel()))


def _block_sums(rank: int):
    """Of a block's cells and the factors shipped to it: the rows' ids and sums."""
    def sums(cells: pa.Table, shipped: pa.Table):
        i, j, val, w = (cells.column(n).to_numpy() for n in ("i", "j", "val", "w"))
        known = shipped.column("id").to_numpy()
        order = np.argsort(known)
        known = known[order]
        f = shipped.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank)[order]
        at = np.minimum(np.searchsorted(known, j), max(0, len(known) - 1))
        ok = known[at] == j if len(known) else np.zeros(len(j), dtype=bool)
        i, val, w, f = i[ok], val[ok], w[ok], f[at[ok]]
        ids, code = np.unique(i, return_inverse=True)
        g, h = np.zeros((len(ids), rank, rank)), np.zeros((len(ids), rank))
        for a in range(rank):
            wf = w * f[:, a]
            h[:, a] = np.bincount(code, wf * val, len(ids))
            for b in range(a, rank):
                g[:, a, b] = g[:, b, a] = np.bincount(code, wf * f[:, b], len(ids))
        return ids, g, h
    return sums


def half_step(by: Blocks, other: DataFrame, rank: int, lam: float = 0.0) -> DataFrame:
    """H2 on blocked cells: factors of the blocks' rows given ``other`` (id, f).  Only factors are exchanged, and the
    sums of rows where some row lies in several blocks.

    The routes are merged where they lie: millions of them take a few MB on disk, by which Spark would broadcast them
    and hold hundreds of MB on the driver."""
    ship_package(other.sparkSession)
    shipped = by.routes.join(other.hint("merge"), "id").select("to", "id", "f")
    met = by.cells.groupBy("block").cogroup(shipped.groupBy("to"))
    sums = _block_sums(rank)
    if not by.split:
        return met.applyInArrow(lambda cells, f: _solved(*sums(cells, f), float(lam)), FACTOR_SCHEMA)
    n = rank * rank + rank

    def partial(cells: pa.Table, f: pa.Table) -> pa.Table:
        ids, g, h = sums(cells, f)
        return pa.table({"id": pa.array(ids, pa.int64()), "s": _lists(np.concatenate([g.reshape(len(ids), -1), h], axis=1))})

    added = met.applyInArrow(partial, FACTOR_SCHEMA.replace("f ", "s ")).groupBy("id").agg(F.array(*[F.sum(F.get("s", k)) for k in range(n)]).alias("s"))

    def solve(batches):
        for b in batches:
            s = b.column("s").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            yield from _solved(b.column("id").to_numpy(), s[:, :rank * rank].reshape(-1, rank, rank), s[:, rank * rank:], float(lam)).to_batches()

    return added.mapInArrow(solve, FACTOR_SCHEMA)


def wals_half_step(observed: DataFrame, other: DataFrame, rank: int, lam: float = 0.0) -> DataFrame:
    """H2: new factors for the i side given the j side's factors ``other``.

    ``observed`` is (i, j, val, w).  Rows i with no sample get no factor
    (factor_matrix fills zeros), as the closed form gives 0 there.
    """
    return half_step(blocks(observed), other, rank, lam)


def random_init(ids: DataFrame, rank: int, seed: int, id_col: str = "id") -> DataFrame:
    """H4: a random orthonormal n x r factor: hashed Gaussians whitened by
    their r x r Gram matrix (one aggregate; the r x r inverse root is
    computed on the driver, size bounded by r)."""
    base = ids.select(F.col(id_col).cast("bigint").alias("id"))
    g = base.select("id", F.array(*[gaussian(seed, "init", F.col("id"), F.lit(a)) for a in range(rank)]).alias("f"))
    gram_row = g.agg(*[F.sum(F.get("f", a) * F.get("f", b)).alias(f"g{a}_{b}")
                       for a in range(rank) for b in range(rank)]).first()
    gram = np.array([[gram_row[f"g{a}_{b}"] or 0.0 for b in range(rank)] for a in range(rank)], dtype=float)
    evals, evecs = np.linalg.eigh(gram)
    inv_root = (evecs * np.where(evals > 0, 1.0 / np.sqrt(np.maximum(evals, 1e-300)), 0.0)) @ evecs.T
    cols = []
    for b in range(rank):
        expr = F.lit(0.0)
        for a in range(rank):
            expr = expr + F.get("f", a) * F.lit(float(inv_root[a, b]))
        cols.append(expr)
    return g.select("id", F.array(*cols).alias("f"))


def factor_matrix(ids: DataFrame, factors: DataFrame, rank: int, id_col: str = "id") -> DataFrame:
    """H6: factors over a full id domain; ids without a factor get zeros."""
    dom = ids.select(F.col(id_col).cast("bigint").alias("id")).distinct()
    return dom.join(factors, "id", "left").select(
        "id", F.coalesce(F.col("f"), F.array_repeat(F.lit(0.0), rank)).alias("f"))


def reconstruct(cells_ij: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """H7: (i, j) -> (i, j, est = u_i·v_j); missing factors count as zero."""
    uu = u.select(F.col("id").alias("i"), F.col("f").alias("fu"))
    vv = v.select(F.col("id").alias("j"), F.col("f").alias("fv"))
    dotp = F.aggregate(F.zip_with("fu", "fv", lambda p, q: p * q), F.lit(0.0), lambda acc, x: acc + x)
    return cells_ij.join(uu, "i", "left").join(vv, "j", "left") \
        .withColumn("est", F.coalesce(dotp, F.lit(0.0))).drop("fu", "fv")


def wals(observed: DataFrame, v_ids: DataFrame, rank: int, iters: int = 10, lam: float = 0.0,
         seed: int = 0, checkpoint_every: int = 4):
    """H3: alternate u and v for ``iters`` rounds from a random orthonormal v.

    The cells are exchanged twice, into blocks by i and by j; the rounds
    exchange factors only.  Each half-step is persisted and every
    ``checkpoint_every``-th one is stored (session.Rounds), with many cells
    every one: the plan stays a few rounds deep and a lost executor redoes
    at most those rounds.  Returns (u, v).
    """
    rounds = Rounds(1 if observed.count() >= STORE_ROUNDS_FROM else checkpoint_every)
    by_i, by_j = blocks(observed, "i", "j"), blocks(observed, "j", "i")
    v = rounds.keep(random_init(v_ids, rank, seed))
    u = None
    for _ in range(iters):
        u = rounds.keep(half_step(by_i, v, rank, lam))
        v = rounds.keep(half_step(by_j, u, rank, lam))
    if u is None:
        u = rounds.keep(half_step(by_i, v, rank, lam))
    by_i.release()
    by_j.release()
    return u, v


def factorize_als(observed: DataFrame, rank: int, iters: int = 10, reg: float = 1e-6, seed: int = 0,
                  implicit: bool = False):
    """H1: Spark MLlib ALS on the sampled cells.

    MLlib needs INT ids, so the ids of each side are densified first, and a
    positive ``regParam``; it computes in FLOAT, and the factors are cast to
    DOUBLE.  Its λ is scaled by the number of ratings per row (unlike H2).
    """
    from pyspark.ml.recommendation import ALS

    from rankfold.operators.prefix import prefix_sums

    if reg <= 0:
        raise ValueError("MLlib ALS needs a positive reg")

    def dense(col: str, out: str) -> DataFrame:
        ids = observed.select(F.col(col).cast("bigint").alias(col)).distinct()
        return prefix_sums(ids, col, {out: F.lit(1).cast("bigint")}).select(col, F.col(out + "_lo").cast("int").alias(out))

    users, items = dense("i", "user").cache(), dense("j", "item").cache()
    data = observed.select("i", "j", F.col("val").cast("float").alias("rating")).join(users, "i").join(items, "j") \
        .select("user", "item", "rating")
    als = ALS(rank=rank, maxIter=iters, regParam=reg, seed=seed, implicitPrefs=implicit,
              userCol="user", itemCol="item", ratingCol="rating", nonnegative=False,
              coldStartStrategy="nan")
    model = als.fit(data)
    u = model.userFactors.join(users.withColumnRenamed("user", "id"), "id").select(
        F.col("i").alias("id"), F.col("features").cast("array<double>").alias("f"))
    v = model.itemFactors.join(items.withColumnRenamed("item", "id"), "id").select(
        F.col("j").alias("id"), F.col("features").cast("array<double>").alias("f"))
    return u, v
