"""Seeded, partition-independent randomness as Spark Column expressions.

Every random quantity in the library is a pure function of
``(seed, purpose, ids...)``: the key string is md5-hashed and the first
52 bits (13 hex digits) give an integer ``h`` in ``[0, 2**52)``, so that
``h + 0.5`` is still an exact double.  The same value is
produced for any partitioning, any retry of a lost task and by the DuckDB
twins below (``sql_*``), which is what lets the oracle reproduce sampled
and sketched results exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = 4503599627370496.0
TWO51 = 2251799813685248
HEX_DIGITS = 13


def _as_col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hash_key(seed: int, purpose: str, *ids) -> Column:
    parts = [F.lit(str(int(seed))), F.lit(purpose)] + [_as_col(i).cast("string") for i in ids]
    return F.concat_ws(":", *parts)


def hash52(seed: int, purpose: str, *ids) -> Column:
    """Integer in [0, 2**52) from the first 13 hex digits of md5(key)."""
    return F.conv(F.substring(F.md5(hash_key(seed, purpose, *ids)), 1, HEX_DIGITS), 16, 10).cast("bigint")


def uniform(seed: int, purpose: str, *ids) -> Column:
    """Uniform in the open interval (0, 1)."""
    return (hash52(seed, purpose, *ids) + F.lit(0.5)) / F.lit(TWO52)


def sign(seed: int, purpose: str, *ids) -> Column:
    """+1.0 or -1.0 with equal probability: whether hash52 is in its upper half, which the first hex digit tells."""
    return F.when(F.substring(F.md5(hash_key(seed, purpose, *ids)), 1, 1) >= F.lit("8"), F.lit(1.0)).otherwise(F.lit(-1.0))


def gaussian(seed: int, purpose: str, *ids) -> Column:
    """Standard normal by Box-Muller on two independent hashed uniforms; null if an id is.

    The key of ids that aren't null is put together by ``concat`` after one constant, which costs less than ``concat_ws``.
    """
    def drawn(of: str) -> Column:
        parts = [p for i in ids for p in (F.lit(":"), _as_col(i).cast("string"))]
        key = F.concat(F.lit(f"{int(seed)}:{purpose}.{of}"), *parts)
        return (F.conv(F.substring(F.md5(key), 1, HEX_DIGITS), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO52)

    u1, u2 = drawn("r"), drawn("t")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


# ---------------------------------------------------------------------------
# DuckDB twins (used by the oracle SQL in __spark_entry__ and by tests)
# ---------------------------------------------------------------------------

def sql_hash_key(seed: int, purpose: str, *ids: str) -> str:
    parts = [f"'{int(seed)}'", f"'{purpose}'"] + [f"CAST({i} AS VARCHAR)" for i in ids]
    return "concat_ws(':', " + ", ".join(parts) + ")"


def sql_hash52(seed: int, purpose: str, *ids: str) -> str:
    return f"(('0x' || substr(md5({sql_hash_key(seed, purpose, *ids)}), 1, {HEX_DIGITS}))::BIGINT)"


def sql_uniform(seed: int, purpose: str, *ids: str) -> str:
    return f"(({sql_hash52(seed, purpose, *ids)} + 0.5) / {TWO52!r})"


def sql_sign(seed: int, purpose: str, *ids: str) -> str:
    return f"(CASE WHEN {sql_hash52(seed, purpose, *ids)} >= {TWO51} THEN 1.0 ELSE -1.0 END)"


def sql_gaussian(seed: int, purpose: str, *ids: str) -> str:
    u1 = sql_uniform(seed, purpose + ".r", *ids)
    u2 = sql_uniform(seed, purpose + ".t", *ids)
    return f"(sqrt(-2.0 * ln({u1})) * cos({2.0 * math.pi!r} * {u2}))"


# ---------------------------------------------------------------------------
# Driver-side twins, for parameter-sized values only (k coordinates, one
# sign per row of a dense vector): identical numbers to the Column forms.
# ---------------------------------------------------------------------------

def py_hash52(seed: int, purpose: str, *ids) -> int:
    import hashlib

    key = ":".join([str(int(seed)), purpose] + [str(i) for i in ids])
    return int(hashlib.md5(key.encode("utf-8")).hexdigest()[:HEX_DIGITS], 16)


def py_uniform(seed: int, purpose: str, *ids) -> float:
    return (py_hash52(seed, purpose, *ids) + 0.5) / TWO52


def py_sign(seed: int, purpose: str, *ids) -> float:
    return 1.0 if py_hash52(seed, purpose, *ids) >= TWO51 else -1.0
