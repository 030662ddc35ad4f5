"""ARRAY<DOUBLE> kernels built from Spark's higher-order functions.

All of these stay inside the JVM (no Python per row): ``transform``,
``aggregate``, ``zip_with`` and ``element_at`` evaluate on Tungsten arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_pow2(d: int) -> int:
    """Smallest power of two >= d (d itself if already one); 1 for d <= 1."""
    if d <= 1:
        return 1
    return 1 << (int(d) - 1).bit_length()


def sum_squares(vec: Column) -> Column:
    """Squared Euclidean norm of an array column."""
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def dot(x: Column, y: Column) -> Column:
    """Dot product of two equal-length array columns."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def pad_to(vec: Column, d: int, n: int) -> Column:
    """Append n - d zeros to a length-d array (no-op when n == d)."""
    v = vec.cast("array<double>")
    if n == d:
        return v
    return F.concat(v, F.array_repeat(F.lit(0.0), n - d))


def times_literal(vec: Column, values: list[float]) -> Column:
    """Element-wise product with a constant array (e.g. the shared sign vector)."""
    return F.zip_with(vec.cast("array<double>"), F.array(*[F.lit(float(v)) for v in values]),
                      lambda p, q: p * q)


def hadamard(vec: Column, n: int, finish=None) -> Column:
    """Unnormalised Walsh-Hadamard transform, natural (Sylvester) order.

    ``y[h] = sum_r (-1)^popcount(h & r) x[r]`` for an array of length n (a
    power of two).  log2(n) butterfly stages, each one ``transform`` over the
    array produced by the previous stage: O(n log n) per record.
    """
    if n & (n - 1):
        raise ValueError(f"length {n} is not a power of two")
    stages = n.bit_length() - 1
    v = vec.cast("array<double>")
    if stages == 0:
        return v if finish is None else finish(v)

    def stage(acc: Column, h: Column) -> Column:
        return F.transform(
            acc,
            lambda x, i: F.when(i.bitwiseAND(h) == 0,
                                x + F.get(acc, i + h))
            .otherwise(F.get(acc, i - h) - x),
        )

    halves = F.array(*[F.lit(1 << s) for s in range(stages)])
    if finish is None:
        return F.aggregate(halves, v, stage)
    # ``finish`` sees the transformed array as a lambda variable, so reading
    # several positions from it does not re-run the transform per position
    return F.aggregate(halves, v, stage, finish)


def gather(vec: Column, idx: list[int]) -> Column:
    """Pick positions ``idx`` (0-based) from an array, in the given order."""
    return F.transform(F.array(*[F.lit(int(i)) for i in idx]), lambda h: F.get(vec, h))
