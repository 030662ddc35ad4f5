"""Gapless positions of rows in an order, without a window over a hot group.

Rows are dealt to ranges of (group, order), so that a group with a third of all rows lies in many ranges, and
numbered inside their range.  One row per (group, range) with its count gives the range's offset in the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import stored

_RANGE_BITS = 33  # monotonically_increasing_id() is the partition's number, shifted by this, plus the row's number in it


def placed(df: DataFrame, group: list[str], order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``_range`` and ``_at``, and the table (group, ``_range``, ``_offset``): a row's position in its group
    is ``_at + _offset``.

    Ascending, nulls first, strings by their UTF-8 bytes.  Rows that agree in all of ``order`` get positions in any
    order.  The table has at most one row per group and range; ``df`` is evaluated twice (a sample, then all), so it
    should be cheap or stored.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in group + order] + [F.col("_seq")]
    rows = df.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_seq")
    at = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("_id", at).withColumn("_range", F.shiftright("_id", _RANGE_BITS).cast("int"))
                  .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))).drop("_id"), label)
    spans = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # at most one row per range in each window group
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    offsets = spans.select(*group, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
                           F.sum("_n").over(whole).alias("_size"))
    return rows, offsets
