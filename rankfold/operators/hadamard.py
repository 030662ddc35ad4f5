"""Subsampled Hadamard transform by blocks.

H_N of order N = 2^b is a Kronecker product of smaller Hadamard matrices: with a row r and a coordinate h split into
groups of bits, H[h, r] is the product of the entries of the groups.  So k picked coordinates need one table of
2^9 x k signs per group of nine bits, and a block of 512 rows (equal upper bits) has a transform of its own whose
picked values are combined across blocks.

* Cells, sorted by column: a block with many cells is transformed as a whole (512 log 512 steps, then k values), cells of
  a block with few take their k signs from the tables.  One task adds up a column's blocks as they come.
* Chunks, arrays of 2^c rows: transformed as a whole, signs hashed once per chunk and task.

A group of (column, block of 2^22 rows) bounds what one task gets of a column.  With more rows than that a column's
parts meet in a second exchange: a part with fewer than 64 cells travels as cells, others as k sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.hashing import sign
from rankfold.session import ship_package

GROUP_BITS = 9
BLOCK = 1 << GROUP_BITS
#: Rows of a column that one task gets, as a power of two.
SPLIT_BITS = 22
#: A column's part with fewer cells than this is exchanged as cells.
FEW = 64
#: Numbers in a temporary array.
ELEMENTS = 2_000_000

WIDE = "mat string, col bigint, sk array<double>, norm2 double"
PARTIAL = "mat string, col bigint, row bigint, sv double, val double, sk array<double>, norm2 double"
_ARROW = {"mat": pa.string(), "col": pa.int64(), "row": pa.int64(), "sv": pa.float64(), "val": pa.float64(),
          "sk": pa.list_(pa.float64()), "norm2": pa.float64()}


def no_list():
    """An array for rows without one: empty, as Spark hands null arrays to Python in a time quadratic in a batch's rows."""
    return F.array().cast("array<double>")


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[n]) for n in (p.split()[0] for p in ddl.split(", "))])


def fast_transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis (a power of two), natural order; ``x`` is overwritten."""
    n, h = x.shape[-1], 1
    while h < n:
        v = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        low, high = v[..., 0, :], v[..., 1, :]
        low += high
        high *= -2
        high += low
        h *= 2
    return x


class Signs:
    """H[h, r] at the picked coordinates ``h``, by tables for groups of nine bits."""

    def __init__(self, coords: list[int], n: int):
        h = np.array(coords, dtype=np.int64)
        groups = max(1, -(-max(1, n - 1).bit_length() // GROUP_BITS))
        r = np.arange(BLOCK, dtype=np.int64)[:, None]
        self.low = h & (BLOCK - 1)
        self.tables = []
        for g in range(groups):
            both = (h >> (g * GROUP_BITS) & (BLOCK - 1)) & r
            self.tables.append((1 - 2 * (np.bitwise_count(both) & 1).astype(np.int8)).astype(np.int8))
        self.k = len(coords)

    def upper(self, block: np.ndarray) -> np.ndarray:
        """Signs of the bits above the lowest nine, for each block."""
        out = np.ones((len(block), self.k), dtype=np.int8)
        for g, table in enumerate(self.tables[1:]):
            out *= table[block >> (g * GROUP_BITS) & (BLOCK - 1)]
        return out

    def column_sums(self, row: np.ndarray, value: np.ndarray, column: np.ndarray, columns: int) -> np.ndarray:
        """Per column the sums over its cells of value x H[h, row]; ``column`` is ascending."""
        out = np.zeros((columns, self.k))
        block = row >> GROUP_BITS
        order = np.lexsort((block, column))
        row, value, column, block = row[order], value[order], column[order], block[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (column[1:] != column[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(row)))
        # a transform costs about four steps per number, a sign from the tables two
        full = size * self.k > 2 * BLOCK * GROUP_BITS + 2 * self.k
        of = np.cumsum(new) - 1
        step = max(1, ELEMENTS // self.k)
        few = np.flatnonzero(~full[of])
        for a in range(0, len(few), step):
            c = few[a:a + step]
            terms = (self.tables[0][row[c] & (BLOCK - 1)] * self.upper(block[c])) * value[c][:, None]
            start = np.flatnonzero(np.append(True, column[c][1:] != column[c][:-1]))
            out[column[c][start]] += np.add.reduceat(terms, start, axis=0)
        many = np.flatnonzero(full)
        step = max(1, ELEMENTS // max(self.k, BLOCK))
        for a in range(0, len(many), step):
            g = many[a:a + step]
            dense = np.zeros((len(g), BLOCK))
            for k, (b, n) in enumerate(zip(first[g], size[g])):
                np.add.at(dense[k], row[b:b + n] & (BLOCK - 1), value[b:b + n])
            terms = fast_transform(dense)[:, self.low] * self.upper(block[first[g]])
            at = column[first[g]]
            start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out[at[start]] += np.add.reduceat(terms, start, axis=0)
        return out


def _lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(rows.ravel()))


def _runs(mat: pa.Array, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each run of equal (mat, col), and the run of each row."""
    m = mat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.ones(len(col), dtype=bool)
    new[1:] = (col[1:] != col[:-1]) | (m[1:] != m[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


class _Sums:
    """Adds up what comes of one column after the other, and gives each out when the next one begins."""

    def __init__(self, scale: float = 1.0):
        self.key, self.sk, self.norm2, self.scale = None, None, 0.0, scale

    def add(self, mats: list, cols: np.ndarray, sums: np.ndarray, norms: np.ndarray) -> Iterator[tuple]:
        """Rows (mat, col, sk, norm2) of the columns that are complete."""
        if self.key == (mats[0], int(cols[0])):
            sums[0] += self.sk
            norms[0] += self.norm2
        else:
            yield from self.rest()
        if len(cols) > 1:
            yield mats[:-1], cols[:-1], sums[:-1] * self.scale, norms[:-1]
        self.key, self.sk, self.norm2 = (mats[-1], int(cols[-1])), sums[-1].copy(), float(norms[-1])

    def rest(self) -> Iterator[tuple]:
        if self.key is not None:
            yield [self.key[0]], np.array([self.key[1]]), self.sk[None, :] * self.scale, np.array([self.norm2])
            self.key = None


def _wide_batch(mats, cols, sums, norms) -> pa.RecordBatch:
    schema = _arrow_schema(WIDE)
    return pa.RecordBatch.from_arrays([pa.array(mats, pa.string()), pa.array(cols, pa.int64()), _lists(sums), pa.array(norms)], schema=schema)


def _column_batches(signs: Signs, scale: float):
    """Rows of PARTIAL, those of a column side by side, to one wide row for each column."""
    def run(batches):
        held = _Sums(scale)
        for whole in batches:
            step = max(1, ELEMENTS // signs.k)
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                col = b.column("col").to_numpy(zero_copy_only=False)
                first, run_of = _runs(b.column("mat"), col)
                cell = b.column("row").is_valid().to_numpy(zero_copy_only=False)
                c = np.flatnonzero(cell)
                value = b.column("val").to_numpy(zero_copy_only=False)
                sums = signs.column_sums(b.column("row").take(pa.array(c)).to_numpy(zero_copy_only=False).astype(np.int64),
                                         b.column("sv").to_numpy(zero_copy_only=False)[c], run_of[c], len(first))
                norms = np.bincount(run_of[c], weights=value[c] ** 2, minlength=len(first))
                parts = np.flatnonzero(~cell)
                if len(parts):
                    sk = np.stack([np.asarray(b.column("sk")[int(p)].values) for p in parts])
                    np.add.at(sums, run_of[parts], sk)
                    np.add.at(norms, run_of[parts], b.column("norm2").to_numpy(zero_copy_only=False)[parts])
                mats = b.column("mat").take(pa.array(first)).to_pylist()
                for out in held.add(mats, col[first], sums, norms):
                    yield _wide_batch(*out)
        for out in held.rest():
            yield _wide_batch(*out)
    return run


def _partial_batches(signs: Signs):
    """Cells of (column, block) groups, sorted by column: columns with few cells in a batch stay cells, others become sums."""
    schema = _arrow_schema(PARTIAL)

    def run(batches):
        for whole in batches:
            step = max(FEW, ELEMENTS // signs.k)
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                col = b.column("col").to_numpy(zero_copy_only=False)
                first, run_of = _runs(b.column("mat"), col)
                size = np.diff(np.append(first, len(col)))
                few = size[run_of] < FEW
                cells = b.filter(pa.array(few))
                n = cells.num_rows
                yield pa.RecordBatch.from_arrays([cells.column(x) for x in ("mat", "col", "row", "sv", "val")] + [
                    pa.array([[]] * n, _ARROW["sk"]), pa.nulls(n, pa.float64())], schema=schema)
                g = np.flatnonzero(size >= FEW)
                if not len(g):
                    continue
                c = np.flatnonzero(~few)
                dense = np.searchsorted(g, run_of[c])
                sums = signs.column_sums(b.column("row").to_numpy(zero_copy_only=False)[c], b.column("sv").to_numpy(zero_copy_only=False)[c], dense, len(g))
                norms = np.bincount(dense, weights=b.column("val").to_numpy(zero_copy_only=False)[c] ** 2, minlength=len(g))
                at = pa.array(first[g])
                none = [pa.nulls(len(g), _ARROW[x]) for x in ("row", "sv", "val")]
                yield pa.RecordBatch.from_arrays([b.column("mat").take(at), b.column("col").take(at), *none, _lists(sums), pa.array(norms)], schema=schema)
    return run


def sketch_cells(cells: DataFrame, coords: list[int], seed: int, n: int) -> DataFrame:
    """(mat, col, sk[k], norm2): the subsampled transform of every column, scaled by 1/sqrt(k), and its exact squared norm.

    ``n`` is the padded length; ``cells`` is exchanged once by column, whatever k is.
    """
    ship_package(cells.sparkSession)
    signs = Signs(coords, n)
    signed = cells.select("mat", F.col("col").cast("bigint").alias("col"), F.col("row").cast("bigint").alias("row"),
                          (sign(seed, "sign", F.col("row")) * F.col("val")).alias("sv"), F.col("val").cast("double").alias("val"))
    if n > 1 << SPLIT_BITS:
        parts = signed.repartition("mat", "col", F.shiftright("row", SPLIT_BITS)).sortWithinPartitions("col", "mat")
        signed = parts.mapInArrow(_partial_batches(signs), PARTIAL)
    else:
        signed = signed.withColumn("sk", no_list()).withColumn("norm2", F.lit(None).cast("double"))
    columns = signed.repartition("mat", "col").sortWithinPartitions("col", "mat")  # numbers first: sorted by prefix
    return columns.mapInArrow(_column_batches(signs, 1.0 / math.sqrt(len(coords))), WIDE)


# ---------------------------------------------------------------------------
# chunked dense columns
# ---------------------------------------------------------------------------

def chunked(vecs: DataFrame, size: int) -> DataFrame:
    """(mat, col, vec) to (mat, col, chunk, vec) with arrays of at most ``size`` numbers."""
    last = F.floor((F.size("vec") - 1) / size).cast("int")
    return vecs.where(F.size("vec") > 0).select("mat", "col", "vec", F.explode(F.sequence(F.lit(0), last)).alias("chunk")) \
        .select("mat", "col", F.col("chunk").cast("bigint").alias("chunk"),
                F.slice("vec", F.col("chunk") * size + 1, F.lit(size)).cast("array<double>").alias("vec"))


def chunks_of_cells(cells: DataFrame, size: int) -> DataFrame:
    """Cells as chunked columns; rows without a cell are 0, chunks without one are left out."""
    place = F.struct(F.pmod("row", F.lit(size)).alias("at"), "val")
    g = cells.groupBy("mat", "col", F.floor(F.col("row") / size).alias("chunk")).agg(F.map_from_entries(F.collect_list(place)).alias("m"))
    at = F.sequence(F.lit(0).cast("bigint"), F.lit(size - 1).cast("bigint"))  # at most ``size`` cells each
    return g.select("mat", "col", F.col("chunk").cast("bigint").alias("chunk"),
                    F.transform(at, lambda a: F.coalesce(F.element_at("m", a), F.lit(0.0))).alias("vec"))


def chunk_norms(chunks: DataFrame) -> DataFrame:
    """Squared column norms of chunked columns: (mat, col, norm2)."""
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    return chunks.groupBy("mat", "col").agg(F.sum(square).alias("norm2"))


def _chunk_batches(coords: list[int], size: int, seed: int, scale: float):
    """Chunks to sums of k numbers, one row for the chunks of a column that follow each other."""
    def run(batches):
        h = np.array(coords, dtype=np.int64)
        low, high = h & (size - 1), h // size

        @lru_cache(maxsize=max(1, (1 << 23) // size))  # 64 MB of signs
        def signs(chunk):
            rows = range(chunk * size, (chunk + 1) * size)
            # the hash is in its upper half if and only if its first bit is set
            return np.array([1.0 if hashlib.md5(f"{seed}:sign:{r}".encode()).digest()[0] > 127 else -1.0 for r in rows])

        held = _Sums(scale)
        step = max(1, ELEMENTS // max(size, len(coords)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                col = b.column("col").to_numpy(zero_copy_only=False)
                first, run_of = _runs(b.column("mat"), col)
                x, norms = np.zeros((b.num_rows, size)), np.zeros(b.num_rows)
                which = b.column("chunk").to_pylist()
                for k, (c, v) in enumerate(zip(which, b.column("vec"))):
                    v = v.values.to_numpy(zero_copy_only=False)
                    norms[k] = v @ v
                    x[k, :len(v)] = v * signs(c)[:len(v)]
                upper = 1.0 - 2.0 * (np.bitwise_count(high[None, :] & np.array(which)[:, None]) & 1)
                got = fast_transform(x)[:, low] * upper
                sums = np.add.reduceat(got, first, axis=0)
                for out in held.add(b.column("mat").take(pa.array(first)).to_pylist(), col[first], sums, np.add.reduceat(norms, first)):
                    yield _wide_batch(*out)
        for out in held.rest():
            yield _wide_batch(*out)
    return run


def _add_up(scale: float):
    def run(batches):
        held = _Sums(scale)
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column("col").to_numpy(zero_copy_only=False)
            first, _ = _runs(b.column("mat"), col)
            k = len(b.column("sk")[0])
            sk = b.column("sk").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            norms = np.add.reduceat(b.column("norm2").to_numpy(zero_copy_only=False), first)
            for out in held.add(b.column("mat").take(pa.array(first)).to_pylist(), col[first], np.add.reduceat(sk, first, axis=0), norms):
                yield _wide_batch(*out)
        for out in held.rest():
            yield _wide_batch(*out)
    return run


def sketch_chunks(chunks: DataFrame, coords: list[int], seed: int, n: int, size: int) -> DataFrame:
    """(mat, col, sk[k], norm2) of chunked columns, padded to length n; chunks hold ``size`` rows, a power of two.

    Chunks of a column that lie together are added up before the exchange, which moves k numbers for each.  Columns of
    one chunk aren't exchanged.
    """
    if size & (size - 1) or size > n:
        raise ValueError(f"chunks of {size} rows: not a power of two up to {n}")
    ship_package(chunks.sparkSession)
    scale = 1.0 / math.sqrt(len(coords))
    parts = chunks.select("mat", "col", "chunk", "vec").mapInArrow(_chunk_batches(coords, size, seed, scale if size == n else 1.0), WIDE)
    if size == n:
        return parts
    return parts.repartition("mat", "col").sortWithinPartitions("mat", "col").mapInArrow(_add_up(scale), WIDE)
