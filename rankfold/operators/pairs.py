"""Sums of a·b over pairs of cells, for the sampled (i, j) only.

The pairs of a task are added up by (i, j), dealt to buckets by a hash of (i, j) and exchanged as packs: i in differences,
j and the sums, byte by byte, of which Spark's compression leaves a few bytes a pair.  The samples are packed alike.  A
bucket's packs meet its samples one after the other, and what isn't sampled is dropped there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import ship_package

#: Pairs or samples that are packed at a time.
PACK = 500_000
#: Samples of a bucket, about.
SAMPLES = 500_000

_PACKS = "bucket int, n int, pack binary"


def _bytewise(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(pack: bytes, at: int, n: int, kind: type) -> np.ndarray:
    part = np.frombuffer(pack, np.uint8, 8 * n, 8 * n * at).reshape(8, n)
    return np.ascontiguousarray(part.T).view(kind).ravel()


def pack(i: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of 8 bytes with i ascending."""
    return b"".join(_bytewise(x) for x in (np.diff(i, prepend=np.int64(0)), *others))


def unpack(pack: bytes, n: int, values: int) -> list[np.ndarray]:
    """i, j and ``values`` columns of doubles."""
    return [np.cumsum(_numbers(pack, 0, n, np.int64)), _numbers(pack, 1, n, np.int64), *(_numbers(pack, 2 + k, n, np.float64) for k in range(values))]


def _packs(values: list[str], add: bool):
    """Packs of (bucket, i, j, values...); ``add``: one entry for each (i, j), the values added up."""
    def dealt(held: list) -> pa.RecordBatch:
        bucket, i, j, *rest = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((j, i, bucket))
        bucket, i, j, rest = bucket[order], i[order], j[order], [x[order] for x in rest]
        if add:
            first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (bucket[1:] != bucket[:-1])]))
            bucket, i, j, rest = bucket[first], i[first], j[first], [np.add.reduceat(x, first) for x in rest]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(bucket))
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[starts], pa.int32()), pa.array(ends - starts, pa.int32()),
            pa.array([pack(*(x[s:e] for x in (i, j, *rest))) for s, e in zip(starts, ends)], pa.binary())], names=["bucket", "n", "pack"])

    def run(batches):
        held, count = [], 0
        for b in batches:
            if b.num_rows:
                held.append([b.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "i", "j", *values)])
                count += b.num_rows
            if count >= PACK:
                yield dealt(held)
                held, count = [], 0
        if held:
            yield dealt(held)
    return run


def _unpacked(packs: pa.Table, values: int):
    for n, blob in zip(packs.column("n"), packs.column("pack")):
        yield unpack(blob.as_buffer(), n.as_py(), values)


def _valued(values: list[str]):
    def run(packs: pa.Table, samples: pa.Table) -> pa.Table:
        parts = list(_unpacked(samples, len(values)))
        si, sj, *rest = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * len(values)
        if len(si):
            ui, uj = np.unique(si), np.unique(sj)
            known, of = np.unique(np.searchsorted(ui, si) * len(uj) + np.searchsorted(uj, sj), return_inverse=True)
            sums = np.zeros(len(known))
            for i, j, v in _unpacked(packs, 1):
                at_i, at_j = np.minimum(np.searchsorted(ui, i), len(ui) - 1), np.minimum(np.searchsorted(uj, j), len(uj) - 1)
                ok = (ui[at_i] == i) & (uj[at_j] == j)
                key, v = at_i[ok] * len(uj) + at_j[ok], v[ok]
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                hit = known[at] == key
                sums += np.bincount(at[hit], v[hit], len(known))
            rest.append(sums[of])
        else:
            rest.append(np.zeros(0))
        return pa.table(dict(zip(["i", "j", *values, "val"], [si, sj, *rest])))
    return run


def sampled_sums(pairs: DataFrame, samples: DataFrame, tasks: int) -> DataFrame:
    """``samples`` (i, j, ...) with ``val``, the sum of a·b over ``pairs`` (i, j, a, b) of the same (i, j), 0 without any."""
    ship_package(samples.sparkSession)
    values = [c for c in samples.columns if c not in ("i", "j")]
    kinds = dict(samples.dtypes)
    if any(kinds[c] != "double" for c in values):
        return samples.join(sampled_sums(pairs, samples.select("i", "j").distinct(), tasks), ["i", "j"])
    n = max(tasks, math.ceil(samples.count() / SAMPLES))
    i, j = (F.col(c).cast("bigint").alias(c) for c in "ij")
    bucket = F.pmod(F.xxhash64(i, j), F.lit(n)).cast("int").alias("bucket")
    made = pairs.select(bucket, i, j, (F.col("a") * F.col("b")).alias("v")).where(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("v").isNotNull())
    left = made.mapInArrow(_packs(["v"], True), _PACKS)
    right = samples.select(bucket, i, j, *values).mapInArrow(_packs(values, False), _PACKS)
    schema = ", ".join(["i bigint", "j bigint", *(f"`{c}` double" for c in [*values, "val"])])
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_valued(values), schema)
