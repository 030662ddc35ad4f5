"""Sampled dot products on a grid of tiles.

The sampled cells (i, j) of a product and the vectors of its columns are dealt to a grid: columns of A by a hash of i to
its lines, columns of B by a hash of j to its columns.  A vector of A goes once to each tile of its line, one of B once
to each tile of its column, and a sample to the one tile where both are.  So the exchange moves
(columns of A) x (grid columns) + (columns of B) x (grid lines) vectors, however many samples there are, and a
vector of A and one of B that are both sampled a thousand times still come once to a tile.

A side of a tile holds some TILE_BYTES of vectors.  The samples of a tile are read as a stream behind its vectors; a tile
with more than SAMPLES samples (a hot i or j) stands as often as needed, with a share of the samples each by a
hash of (i, j).  Vectors in chunks give a partial product for each chunk, which are then added up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.operators.hadamard import no_list
from rankfold.session import ship_package

TILE_BYTES = 32 << 20
SAMPLES = 1_000_000
#: Numbers gathered at a time.
ELEMENTS = 1_000_000
MOST_TILES = 4096

_DOTS = "i bigint, j bigint, chunk bigint, dot double, sa2 double, sb2 double, a2 double, b2 double"


def grid(n_a: int, n_b: int, length: int, at_least: int) -> tuple[int, int]:
    """Lines and columns of the grid: sides of TILE_BYTES, and at least ``at_least`` tiles in all."""
    lines = max(1, math.ceil(8 * n_a * length / TILE_BYTES))
    columns = max(1, math.ceil(8 * n_b * length / TILE_BYTES))
    while lines * columns < at_least:
        if lines * n_b <= columns * n_a:  # the cheaper side to copy once more
            lines += 1
        else:
            columns += 1
    return lines, columns


class _Side:
    """Vectors of one side of a tile, by id."""

    def __init__(self):
        self.ids, self.rows, self.norms = [], [], []
        self.sorted = None

    def add(self, ids: np.ndarray, vectors: pa.Array, norms: np.ndarray) -> None:
        self.ids.append(ids)
        self.norms.append(norms)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(vectors.offsets.to_numpy())
        if len(size) and (size == size[0]).all():
            self.rows.append(flat.reshape(len(size), size[0]))
        else:  # the last chunks may be shorter
            out = np.zeros((len(size), size.max(initial=0)))
            at = np.cumsum(size) - size
            for k, (a, n) in enumerate(zip(at, size)):
                out[k, :n] = flat[a:a + n]
            self.rows.append(out)

    def matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in order, their vectors and given norms; a last row of zeros stands for ids without a vector."""
        if self.sorted is None:
            width = max((r.shape[1] for r in self.rows), default=0)
            rows = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in self.rows] + [np.zeros((1, width))])
            ids, norms = np.concatenate([*self.ids, np.zeros(0, dtype=np.int64)]), np.concatenate([*self.norms, np.zeros(1)])
            order = np.argsort(ids, kind="stable")
            last = np.append(order, len(ids))
            self.sorted = ids[order], rows[last], norms[last]
        return self.sorted

    def find(self, ids: np.ndarray) -> np.ndarray:
        known = self.matrix()[0]
        if not len(known):
            return np.zeros(len(ids), dtype=np.int64)
        at = np.searchsorted(known, ids)
        return np.where(known[np.minimum(at, len(known) - 1)] == ids, at, len(known))


def _tile_batches(batches):
    """Rows (tile, part, chunk, kind, i, j, vec, norm2, rest), sorted by the first four: vectors of A, of B, then samples."""
    key, a, b = None, None, None
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in ("tile", "part", "chunk", "kind")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            now, kind = tuple(keys[lo, :3].tolist()), keys[lo, 3]
            if now != key:
                key, a, b = now, _Side(), _Side()
            rows = batch.slice(lo, hi - lo)
            if kind < 2:
                (a, b)[kind].add(rows.column("i" if kind == 0 else "j").to_numpy(zero_copy_only=False), rows.column("vec"),
                                 rows.column("norm2").to_numpy(zero_copy_only=False))
                continue
            i, j = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("i", "j"))
            (_, x, a2), (_, y, b2) = a.matrix(), b.matrix()
            width = min(x.shape[1], y.shape[1])
            at_i, at_j = a.find(i), b.find(j)
            dots, step = np.zeros(len(i)), max(1, ELEMENTS // max(1, width))
            for s in range(0, len(i), step):
                e = slice(s, s + step)
                dots[e] = np.einsum("ij,ij->i", x[at_i[e], :width], y[at_j[e], :width])
            values = (i, j, np.full(len(i), key[2]), dots, np.einsum("ij,ij->i", x, x)[at_i], np.einsum("ij,ij->i", y, y)[at_j], a2[at_i], b2[at_j])
            rest = rows.column("rest")
            names = ["i", "j", "chunk", "dot", "sa2", "sb2", "a2", "b2", "rest"]
            yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in values), rest], names=names)


def tiled_dots(samples: DataFrame, vectors: DataFrame, length: int, tiles: tuple[int, int] | None = None) -> DataFrame:
    """(i, j, chunk, dot, sa2, sb2, a2, b2, rest) of each sampled (i, j) and chunk: dot product and squared norms of its two
    vectors, their given ``norm2``, and the other columns of the sample as a struct.

    ``vectors`` is (mat, col, chunk, vec[, norm2]) with arrays of at most ``length`` numbers; an id without a vector
    counts as 0.  Both frames are counted first, so they should be stored or cheap.
    """
    spark = samples.sparkSession
    ship_package(spark)
    others = [c for c in samples.columns if c not in ("i", "j")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    if "norm2" not in vectors.columns:
        vectors = vectors.withColumn("norm2", F.lit(0.0))
    sizes = {r["mat"]: (r["n"], r["chunk"]) for r in vectors.groupBy("mat").agg(
        F.countDistinct("col").alias("n"), F.max("chunk").alias("chunk")).collect()}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines, columns = tiles or grid(sizes.get("A", (1, 0))[0], sizes.get("B", (1, 0))[0], length, least)
    chunks = max((c for _, c in sizes.values()), default=0)
    line, column = F.pmod(F.xxhash64("i"), F.lit(lines)), F.pmod(F.xxhash64("j"), F.lit(columns))
    dealt = samples.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), rest.alias("rest")) \
        .withColumn("tile", line * columns + column)
    # one number per crowded tile
    crowded = dealt.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SAMPLES).collect()
    parts = F.lit(1)
    if crowded:
        known = F.create_map(*(F.lit(x) for r in crowded for x in (r["tile"], math.ceil(r["n"] / SAMPLES))))
        parts = F.coalesce(F.element_at(known, F.col("tile")), F.lit(1))
    vectors = vectors.select("mat", F.col("col").cast("bigint").alias("col"), F.col("chunk").cast("bigint").alias("chunk"),
                             F.col("vec").cast("array<double>").alias("vec"), F.col("norm2").cast("double").alias("norm2"))

    def copied(mat, kind, own, other, tile_of, copies):
        at = vectors.where(F.col("mat") == mat).withColumnRenamed("col", own).withColumn(other, F.lit(0).cast("bigint"))
        at = at.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), tile_of)))
        return at.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn("kind", F.lit(kind)).withColumn("rest", F.lit(None).cast(kept))

    kept = dealt.schema["rest"].dataType
    dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(int(chunks)).cast("bigint")))).withColumn("kind", F.lit(2)) \
        .withColumn("part", F.pmod(F.xxhash64("i", "j"), parts).cast("int")) \
        .withColumn("vec", no_list()).withColumn("norm2", F.lit(None).cast("double"))
    order = ["tile", "part", "chunk", "kind"]
    names = [*order, "i", "j", "vec", "norm2", "rest"]
    rows = copied("A", 0, "i", "j", lambda c: line * columns + c, columns).select(names) \
        .unionByName(copied("B", 1, "j", "i", lambda r: r * columns + column, lines).select(names)).unionByName(dealt.select(names))
    rows = rows.repartition(max(least, min(lines * columns, 4 * least)), "tile", "part", "chunk").sortWithinPartitions(*order)
    return rows.mapInArrow(_tile_batches, f"{_DOTS}, rest {kept.simpleString()}")


def with_values(samples: DataFrame, dots: DataFrame, value) -> DataFrame:
    """``samples`` with ``val`` computed from the columns of :func:`tiled_dots`, in the order of its columns."""
    return dots.select(*(F.col(c) if c in ("i", "j") else F.col(f"rest.`{c}`").alias(c) for c in samples.columns), value.alias("val"))
