"""A Bloom sieve for joins: keep the rows whose key may be among wanted keys.

The wanted keys are hashed to ``SLOTS`` bits, held as words of 64 bits, one
row each.  The table of words has at most ``SLOTS / 64`` rows of 16 bytes
whatever the number of keys, so it is broadcast and tested where the rows
are scanned, before they are exchanged for the join proper.  The sieve lets
some other rows through (the join drops them) and never loses a wanted one.
With many more keys than slots it lets nearly all through: the join is then
as dear as without it, and as right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve: 262,144 words, 4 MiB.
SLOTS = 1 << 24


def _slot(key: str, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(slots))


def words(keys: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """(_word, _bits): the bits of all values of ``key``."""
    bit = F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    return keys.select(_slot(key, slots).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")) \
        .agg(F.bit_or(bit).alias("_bits"))


def sieved(df: DataFrame, key: str, keys: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` whose ``key`` (a whole number) may be among ``keys``."""
    if slots < 64 or slots & (slots - 1):
        raise ValueError("slots must be a power of two, 64 at least")
    tested = df.withColumn("_slot", _slot(key, slots)).withColumn("_word", F.shiftright("_slot", 6))
    return tested.join(F.broadcast(words(keys, key, slots)), "_word") \
        .where(F.expr("getbit(_bits, cast(_slot & 63 as int)) = 1")).select(*df.columns)
