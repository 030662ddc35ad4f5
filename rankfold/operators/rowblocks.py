"""Implicit products y = Aᵀ(Bx) over blocks of rows that stay where they are.

Where a pair has many more rows than columns, joins by row exchange a side's cells and the sums of all rows in every
product.  Here the cells of both sides are dealt once to blocks by a hash of their row, so that a block forms w = Bx of
its rows and its share of Aᵀw by itself.  Only entries of x and y are exchanged: a routing table names for each bucket
of ids the blocks that use them, in the order in which a block holds them, so that they travel as arrays of values
without their ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import ship_package

#: Cells of a block, about (A's and B's); one task holds one block at a time.
BLOCK_CELLS = 1_000_000

_PACKED = "block int, mat string, at array<int>, of array<int>, val array<double>, ids array<bigint>, bucket array<int>"
_ROUTES = "mat string, bucket int, block int, ids array<bigint>"
_SHIPPED = "block int, bucket int, f array<double>"


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.ones(len(sorted_keys) + 1, dtype=bool)
    new[1:-1] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new) if len(sorted_keys) else np.zeros(1, dtype=np.int64)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def _array(table: pa.Table, name: str, k: int) -> np.ndarray:
    return table.column(name)[k].values.to_numpy(zero_copy_only=False)


def _pack(t: pa.Table) -> pa.Table:
    """A block's cells as one row for each side, its columns by bucket and id; ``at``: rows of the block, of both sides."""
    row, col, bucket, val = (t.column(n).to_numpy() for n in ("row", "col", "bucket", "val"))
    of_a = t.column("of_a").to_numpy()
    at = np.unique(row, return_inverse=True)[1].astype(np.int32)
    out = []
    for mat, mask in (("A", of_a), ("B", ~of_a)):
        order = np.flatnonzero(mask)
        order = order[np.lexsort((col[order], bucket[order]))]
        first = _starts(col[order])[:-1]
        of = np.zeros(len(order), dtype=np.int32)
        of[first[1:]] = 1
        out.append({"block": t.column("block")[0].as_py(), "mat": mat, "at": at[order], "of": np.cumsum(of, dtype=np.int32), "val": val[order],
                    "ids": col[order][first], "bucket": bucket[order][first].astype(np.int32)})
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("mat", pa.string()), ("at", pa.list_(pa.int32())), ("of", pa.list_(pa.int32())),
                                                       ("val", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("bucket", pa.list_(pa.int32()))]))


def _route(batches):
    """Of each block and side the ids by bucket."""
    for b in batches:
        for k in range(b.num_rows):
            ids, bucket = _array(b, "ids", k), _array(b, "bucket", k)
            s = _starts(bucket)
            n = len(s) - 1
            yield pa.RecordBatch.from_arrays([pa.array([b.column("mat")[k].as_py()] * n, pa.string()), pa.array(bucket[s[:-1]], pa.int32()),
                                              pa.array([b.column("block")[k].as_py()] * n, pa.int32()), _lists(ids, s)], names=["mat", "bucket", "block", "ids"])


def _ids_of(routes: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the routes, one after the other, and where each route's begin."""
    lists = [x.values.to_numpy(zero_copy_only=False) for x in routes.column("ids")]
    return np.concatenate(lists), np.cumsum([0, *map(len, lists)])


def _ship(r: int):
    """Of a bucket's vector entries and its routes: what each block uses, in its order; ids without an entry are 0."""
    def run(x: pa.Table, routes: pa.Table) -> pa.Table:
        if not x.num_rows or not routes.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "f": pa.array([], pa.list_(pa.float64()))})
        ids, starts = _ids_of(routes)
        known = x.column("id").to_numpy()
        order = np.argsort(known)
        known = known[order]
        f = x.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, r)[order]
        at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        got = np.where((known[at] == ids)[:, None], f[at], 0.0)
        return pa.table({"block": routes.column("block"), "bucket": routes.column("bucket"), "f": _lists(got.ravel(), starts * r)})
    return run


def _multiply(first: str, r: int):
    """Of a block and the entries shipped to it: its share of y, by bucket."""
    def run(cells: pa.Table, shipped: pa.Table) -> pa.Table:
        side = {m: k for k, m in enumerate(cells.column("mat").to_pylist())}
        if not shipped.num_rows or not side:
            return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "f": pa.array([], pa.list_(pa.float64()))})
        one, two = side[first], side["B" if first == "A" else "A"]
        bucket = _array(cells, "bucket", one)
        x = np.zeros((len(bucket), r))
        for k, b in enumerate(shipped.column("bucket").to_pylist()):
            lo, hi = np.searchsorted(bucket, [b, b + 1])
            x[lo:hi] = _array(shipped, "f", k).reshape(-1, r)
        (at1, of1, v1), (at2, of2, v2) = ([_array(cells, n, k) for n in ("at", "of", "val")] for k in (one, two))
        rows = max(at1.max(initial=-1), at2.max(initial=-1)) + 1
        bucket = _array(cells, "bucket", two)
        y = np.zeros((len(bucket), r))
        for c in range(r):
            w = np.bincount(at1, v1 * x[of1, c], rows)
            y[:, c] = np.bincount(of2, v2 * w[at2], len(bucket))
        s = _starts(bucket)
        block = cells.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * (len(s) - 1), pa.int32()), "bucket": pa.array(bucket[s[:-1]], pa.int32()), "f": _lists(y.ravel(), s * r)})
    return run


def _add(r: int):
    """Of the shares of a bucket and its routes: the sums by id."""
    def run(shares: pa.Table, routes: pa.Table) -> pa.Table:
        if not routes.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "f": pa.array([], pa.list_(pa.float64()))})
        ids, starts = _ids_of(routes)
        known, at = np.unique(ids, return_inverse=True)
        place = {b: k for k, b in enumerate(routes.column("block").to_pylist())}
        out = np.zeros((len(known), r))
        for b, k in sorted((b, k) for k, b in enumerate(shares.column("block").to_pylist())):
            p = place[b]
            out[at[starts[p]:starts[p + 1]]] += _array(shares, "f", k).reshape(-1, r)
        return pa.table({"id": pa.array(known, pa.int64()), "f": _lists(out.ravel(), np.arange(len(known) + 1) * r)})
    return run


class RowBlocks:
    """The cells of a pair by blocks of rows, in bucketed tables below the checkpoint folder."""

    def __init__(self, cells: DataFrame, block_cells: int = BLOCK_CELLS):
        from rankfold.operators.factorize import bucketed

        ship_package(cells.sparkSession)
        n = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(cells.count() / block_cells))
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        placed = cells.select((F.col("mat") == "A").alias("of_a"), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"),
                              F.col("val").cast("double").alias("val")).withColumn("block", place("row"))
        dealt = placed.repartition(n, "block").withColumn("bucket", place("col"))  # what a column tells is not exchanged
        self.n, self.spark, self.names, self.routes = n, cells.sparkSession, [], {}
        self.cells, name = bucketed(dealt.groupBy("block").applyInArrow(_pack, _PACKED), "block", n, dealt=True)
        self.names.append(name)
        routes = self.cells.select("mat", "block", "ids", "bucket").mapInArrow(_route, _ROUTES)
        for mat in "AB":
            self.routes[mat], name = bucketed(routes.where(F.col("mat") == mat).drop("mat"), "bucket", n)
            self.names.append(name)

    def product(self, x: DataFrame, first: str, r: int) -> DataFrame:
        """(id, f[r]) of Aᵀ(Bx) (first 'B', x over B's columns) or Bᵀ(Ax) (first 'A'); x is (id, f[r])."""
        x = x.select("id", "f").withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(self.n)).cast("int"))
        shipped = x.groupBy("bucket").cogroup(self.routes[first].groupBy("bucket")).applyInArrow(_ship(r), _SHIPPED)
        shares = self.cells.groupBy("block").cogroup(shipped.groupBy("block")).applyInArrow(_multiply(first, r), _SHIPPED)
        return shares.groupBy("bucket").cogroup(self.routes["A" if first == "B" else "B"].groupBy("bucket")).applyInArrow(_add(r), "id bigint, f array<double>")

    def release(self) -> None:
        """Forget the tables; their files stay in the checkpoint folder for frames that still read them."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
