"""Sketches of every column of A and B, and cell estimates from sketches.

SRHT: S = (1/√k)·P·H·diag(sign), H the N x N Walsh-Hadamard matrix in
natural order (H[h, r] = (-1)^popcount(h & r)), P picks k of the N padded
coordinates.  The signs and the k coordinates are shared by A and B, which
is what makes Ãᵀ B̃ an unbiased estimate of AᵀB.

Two physical forms, both by blocks (operators.hadamard):
* cells (sparse, long rows): exchanged once by column; a block of 512 rows is transformed as a whole or, with few
  cells, by tables of signs.
* vecs (dense columns, whole or in chunks): sign, pad, fast transform and pick per chunk; chunks are added up.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.functions import arrays as AR
from rankfold.functions.hashing import gaussian, py_uniform, sign
from rankfold.operators import hadamard as HD
from rankfold.operators import tiles as T
from rankfold.operators.skew import DEFAULT_MIN_ROWS, hot_counted, salted_join
from rankfold.session import cut_lineage


# ---------------------------------------------------------------------------
# shared randomness: signs (B2) and coordinates
# ---------------------------------------------------------------------------

def sign_column(seed: int, row_col="row"):
    """B2: the shared ±1 per row (same for A and B)."""
    return sign(seed, "sign", F.col(row_col))


def pick_coords(seed: int, n: int, k: int) -> list[int]:
    """K distinct coordinates of 0..n-1, uniformly at random.

    Rule (reproduced in SQL): if n <= 2k rank all n positions by a hashed
    uniform and keep the k smallest; otherwise draw candidates
    c_t = floor(u_t·n), t = 0, 1, ... and keep the first k distinct values
    (sequential sampling without replacement).  Output order = draw order,
    so position t of the list is sketch coordinate t.  Size is k: bounded
    by the parameter, not the data.
    """
    k, n = int(k), int(n)
    if k > n:
        raise ValueError(f"sketch size k={k} exceeds padded length N={n}")
    if n > 2 ** 52:
        raise ValueError("padded length above 2**52: hashed uniforms have 52 bits")
    if n <= 2 * k:
        ranked = sorted(range(n), key=lambda h: (py_uniform(seed, "rank", h), h))
        return ranked[:k]
    seen: dict[int, int] = {}
    t = 0
    while len(seen) < k:
        c = int(math.floor(py_uniform(seed, "coord", t) * n))
        if c not in seen:
            seen[c] = t
        t += 1
    return sorted(seen, key=seen.get)


def coords_frame(spark: SparkSession, seed: int, n: int, k: int) -> DataFrame:
    """The coordinates of :func:`pick_coords` as a table (t, h) of k rows."""
    return spark.createDataFrame(list(enumerate(pick_coords(seed, n, k))), "t bigint, h bigint")


def checked_row(n: int, row_col: str = "row"):
    """The row id, or an error if it is not in 0..n-1: a larger or negative
    one would silently share another row's Hadamard column."""
    r = F.col(row_col)
    return F.when((r >= 0) & (r < F.lit(int(n))), r).otherwise(F.raise_error(F.concat(
        F.lit(f"row id outside 0..{int(n) - 1}: "), r.cast("string"))))


def padded_length(d: int) -> int:
    """Rows are padded with zeros up to the next power of two."""
    return AR.next_pow2(d)


def hadamard_entry(h_col, row_col):
    """H[h, r] = 1 - 2·(popcount(h & r) mod 2), natural order."""
    return F.lit(1.0) - F.lit(2.0) * (F.bit_count(h_col.bitwiseAND(row_col)) % 2)


# ---------------------------------------------------------------------------
# SRHT / Gaussian sketches, cells form
# ---------------------------------------------------------------------------

def srht_sketch_wide(cells: DataFrame, coords: list[int], seed: int, n: int | None = None) -> DataFrame:
    """B6 (cells): (mat, col, sk[k], norm2), sketch and exact squared norm of every column from one scan.
    With the padded length ``n``, row ids outside 0..n-1 are an error."""
    if n is not None:
        cells = cells.withColumn("row", checked_row(n))
    # bits of a row above those of all coordinates don't change a sign
    return HD.sketch_cells(cells, coords, seed, n or padded_length(max(coords, default=0) + 1))


def append_coords(wide: DataFrame, cells: DataFrame, coords: list[int], k: int, seed: int, n: int) -> DataFrame:
    """From the sketch for ``coords[:k]`` that for all ``coords``, by one scan of the cells for the new ones alone."""
    new = srht_sketch_wide(cells, coords[k:], seed, n).select("mat", "col", F.col("sk").alias("_new"))
    old, add = math.sqrt(k / len(coords)), math.sqrt((len(coords) - k) / len(coords))
    return wide.join(new, ["mat", "col"]).select("mat", "col", F.concat(
        F.transform("sk", lambda x: x * F.lit(old)), F.transform("_new", lambda x: x * F.lit(add))).alias("sk"), "norm2")


def srht_sketch_cells(cells: DataFrame, coords: list[int], seed: int, with_norms: bool = False,
                      n: int | None = None) -> DataFrame:
    """B6 (cells): long sketch (mat, col, t, s); with_norms adds the exact
    squared column norm as t = -1 from the same scan."""
    wide = srht_sketch_wide(cells, coords, seed, n)
    if not with_norms:
        return wide_to_long(wide)
    return wide.select("mat", "col", F.posexplode(F.concat(F.array("norm2"), "sk")).alias("t", "s")).withColumn("t", F.col("t") - 1)


#: Cells of a task that multiplies them with the draws of their rows, about.
TASK_CELLS = 1_000_000

#: Coordinates of one slice of a Gaussian sketch: that many sums stand in one aggregation.
SLICE = 16


def gaussian_rows(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """(row, g[k]): the column T[:, row]·√k for every row that has a cell, drawn once per row."""
    return rows.select("row").distinct().withColumn(
        "g", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda t: gaussian(seed, "jl", t, F.col("row"))))


def gaussian_sketch_cells(cells: DataFrame, k: int, seed: int, with_norms: bool = False,
                          min_rows: int = DEFAULT_MIN_ROWS) -> DataFrame:
    """T = randn(k, d)/√k applied to every column.  T[t, r] is a hash of
    (seed, t, r), drawn once per row (d·k draws, whatever the number of
    cells) and joined to the row's cells; a hot row's cells are spread over
    sub-keys.  The rows are counted and stored by a first scan.  A cell then makes k/16 rows of 16 products, summed before
    the exchange by column.  with_norms adds the exact squared column norm
    as t = -1 from the same scan."""
    if k < 1:
        raise ValueError("k must be at least 1")
    # rows are counted once: the counts tell hot rows, the tasks, and which rows are drawn
    rows = cut_lineage(cells.where("row IS NOT NULL").groupBy("row").agg(F.count(F.lit(1)).alias("_n")))
    total, hot = hot_counted(rows, "row", min_rows=min_rows)
    if not hot:  # the work is in draws and products, which adaptive execution, sizing tasks by bytes, doesn't see
        tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_CELLS))
        cells, rows = cells.repartition(tasks, "row"), rows.repartition(tasks, "row")
    met = salted_join(cells, gaussian_rows(rows, k, seed), ["row"], "row", hot, "col")
    slices = -(-k // SLICE)
    first = F.col("slice") * SLICE
    # coordinates past k (in the last slice) are null and fall out below
    sums = [F.sum(F.get("g", first + c) * F.col("val")).alias(f"s{c}") for c in range(min(k, SLICE))]
    norm = [F.sum(F.when(F.col("slice") == 0, F.col("val") * F.col("val"))).alias("norm2")] if with_norms else []
    wide = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).groupBy("mat", "col", "slice").agg(*sums, *norm)
    cells_t = [F.struct((first + c).alias("t"), (F.col(f"s{c}") / F.lit(math.sqrt(k))).alias("s")) for c in range(len(sums))]
    if with_norms:
        cells_t.append(F.when(F.col("slice") == 0, F.struct(F.lit(-1).alias("t"), F.col("norm2").alias("s"))))
    return wide.select("mat", "col", F.explode(F.array(*cells_t)).alias("e")).select("mat", "col", "e.t", "e.s") \
        .where(F.col("t") < k)


def sketch_wide(sketch_long: DataFrame, k: int) -> DataFrame:
    """Long (mat, col, t, s) -> wide (mat, col, sk ARRAY<DOUBLE> of length k).

    Each group holds exactly k values (the sketch size), so the collect is
    bounded by the parameter; missing coordinates are zeros.
    """
    g = sketch_long.where(F.col("t") >= 0).groupBy("mat", "col").agg(
        F.map_from_entries(F.collect_list(F.struct("t", "s"))).alias("m"))
    return g.select("mat", "col", F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                                              lambda t: F.coalesce(F.element_at("m", t), F.lit(0.0))).alias("sk"))


# ---------------------------------------------------------------------------
# SRHT, vecs form (B2 -> B3 -> B4 -> B5 in one projection)
# ---------------------------------------------------------------------------

#: Rows of a chunk of a dense column.
CHUNK = 4096


def srht_sketch_chunks(chunks: DataFrame, d: int, coords: list[int], seed: int, size: int = CHUNK) -> DataFrame:
    """(mat, col, chunk, vec) -> (mat, col, sk[k], norm2); ``size``: rows of a chunk, a power of two."""
    return HD.sketch_chunks(chunks, coords, seed, max(padded_length(d), size), size)


def srht_sketch_vecs(vecs: DataFrame, d: int, coords: list[int], seed: int, size: int = CHUNK) -> DataFrame:
    """(mat, col, vec[d]) -> (mat, col, sk[k], norm2).  Columns are cut into chunks where they lie; up to one chunk
    there is no exchange.  The plan doesn't grow with d."""
    size = min(size, padded_length(d))
    return srht_sketch_chunks(HD.chunked(vecs, size), d, coords, seed, size)


def wide_to_long(wide: DataFrame, arr: str = "sk") -> DataFrame:
    return wide.select("mat", "col", F.posexplode(arr).alias("t", "s"))


# ---------------------------------------------------------------------------
# estimates of sampled cells from sketches
# ---------------------------------------------------------------------------

def value_from_sketch(samples: DataFrame, sketch: DataFrame, norms: DataFrame | None = None,
                      estimator: str = "raw") -> DataFrame:
    """For each sampled (i, j) the estimate of M[i, j] from the sketches.

    ``sketch`` is wide (mat, col, sk); samples and sketches meet on a grid of tiles (operators.tiles), so that a
    sketch moves once per tile and not once per sample.
    raw (B10) = ãᵢ·b̃ⱼ; rescaled (B9) = raw/(‖ãᵢ‖‖b̃ⱼ‖)·‖aᵢ‖‖bⱼ‖ (0 if a
    sketched norm is 0); the rescaled form needs the exact ``norms``.
    """
    if estimator not in ("raw", "rescaled"):
        raise ValueError("estimator must be 'raw' or 'rescaled'")
    if estimator == "rescaled" and norms is None:
        raise ValueError("the rescaled estimator needs the exact column norms")
    if estimator == "rescaled" and "norm2" not in sketch.columns:  # the exact norms travel with the sketches
        sketch = sketch.join(norms.select("mat", "col", "norm2"), ["mat", "col"], "left")
    length = sketch.agg(F.max(F.size("sk"))).first()[0] or 1
    given = [F.coalesce("norm2", F.lit(0.0)).alias("norm2")] if estimator == "rescaled" else []
    dots = T.tiled_dots(samples, sketch.select("mat", "col", F.lit(0).alias("chunk"), F.col("sk").alias("vec"), *given), length)
    if estimator == "raw":
        return T.with_values(samples, dots, F.col("dot"))
    none = (F.col("sa2") == 0) | (F.col("sb2") == 0)
    return T.with_values(samples, dots, F.when(none, F.lit(0.0)).otherwise(
        F.col("dot") / F.sqrt("sa2") / F.sqrt("sb2") * F.sqrt("a2") * F.sqrt("b2")))
