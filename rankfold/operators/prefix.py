"""Distributed prefix sums (F1) and CDF lookups (D3) without a global sort
window.

A window ``orderBy`` with no partition moves every row into one task.
Here the key range is cut into at most ``buckets`` ranges (approximate
quantiles, collected once: a bounded list of numbers); per-range totals
(<= buckets rows) give each range its offset, and the running sum inside
a range is an ordinary partitioned window.  The CDF lookup merges sorted
draws with sorted CDF starts inside ranges whose boundaries are both
count-quantiles of the CDF rows and an even grid over the total mass, so a
range holds a bounded share of CDF rows *and* of draws (no hot bucket even
if one column owns a third of the mass).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    """Four ranges per shuffle partition: set that as the cluster and data grow."""
    p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, 4 * p)


def quantile_splits(df: DataFrame, col: str, buckets: int) -> list[float]:
    """Up to buckets-1 increasing split points of ``col`` (one aggregate job)."""
    if buckets <= 1:
        return []
    qs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), qs, 10000).alias("q")).first()
    vals = row["q"] if row is not None and row["q"] is not None else []
    return sorted({float(v) for v in vals if v is not None})


def bucketize(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    """Range bucket by binary search over the split points (JVM-side)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    tmp = out + "__x"
    full = [float("-inf")] + [s for s in splits] + [float("inf")]
    b = Bucketizer(splits=full, inputCol=tmp, outputCol=out + "__d", handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.col(col).cast("double")))
    return res.withColumn(out, F.col(out + "__d").cast("int")).drop(tmp, out + "__d")


def prefix_sums(df: DataFrame, order_col: str, values: dict[str, Column], buckets: int | None = None) -> DataFrame:
    """For each row, the sum of ``values`` over all rows with a smaller
    ``order_col`` (exclusive prefix), as columns ``<name>_lo``.

    ``order_col`` must be unique.  Cost: one quantile job, one small
    aggregate, one partitioned window; never a single-partition sort.
    """
    buckets = buckets or default_buckets(df)
    splits = quantile_splits(df, order_col, buckets)
    b = bucketize(df, order_col, splits, "_bkt")
    for name, expr in values.items():
        b = b.withColumn("_v_" + name, expr)
    tot = b.groupBy("_bkt").agg(*[F.sum("_v_" + n).alias("_t_" + n) for n in values])
    w_off = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)  # <= buckets rows
    off = tot.select("_bkt", *[F.coalesce(F.sum("_t_" + n).over(w_off), F.lit(0)).alias("_o_" + n) for n in values])
    w_in = Window.partitionBy("_bkt").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(F.broadcast(off), "_bkt")  # off has at most `buckets` rows
    for n in values:
        out = out.withColumn(n + "_lo", F.col("_o_" + n) + F.coalesce(F.sum("_v_" + n).over(w_in), F.lit(0)))
    return out.drop("_bkt", *["_v_" + n for n in values], *["_o_" + n for n in values])


def column_cdf(norms_b: DataFrame, key: str = "j", weight: str = "b", buckets: int | None = None) -> DataFrame:
    """(key, weight, idx, lo, hi) with idx = number of keys before this one
    and [lo, hi) this key's share of the cumulative weight, keys ascending."""
    out = prefix_sums(norms_b.select(key, weight), key,
                      {"idx": F.lit(1).cast("bigint"), "lo": F.col(weight).cast("double")}, buckets)
    return out.select(key, weight, F.col("idx_lo").cast("bigint").alias("idx"),
                      F.col("lo_lo").alias("lo"), (F.col("lo_lo") + F.col(weight)).alias("hi"))


def cdf_lookup(draws: DataFrame, x_col: str, cdf: DataFrame, key: str, total: float,
               buckets: int | None = None) -> DataFrame:
    """D3: for each draw with position x in [0, total), the CDF row with
    lo <= x < hi; returns ``draws`` plus ``key``.

    Sorted merge inside balanced ranges (see module doc): each CDF row is
    emitted at its own start and, as a carry, at the start of every later
    range it still covers; inside a range the last start at or before a draw
    is its answer (``last(..., ignorenulls)`` over a partitioned window).
    """
    buckets = buckets or default_buckets(cdf)
    live = cdf.where(F.col("hi") > F.col("lo")).select(key, "lo", "hi")
    mass_grid = [total * g / buckets for g in range(1, buckets)] if total > 0 else []
    splits = sorted(set(quantile_splits(live, "lo", buckets)) | set(mass_grid))
    splits = [s for s in splits if s > 0.0]
    starts = F.array(F.lit(float("-inf")), *[F.lit(float(s)) for s in splits])  # range b starts at starts[b]

    c = bucketize(bucketize(live, "lo", splits, "b0"), "hi", splits, "bh")
    # last range whose start lies strictly below hi
    c = c.withColumn("b1", F.when(F.get(starts, F.col("bh")) < F.col("hi"), F.col("bh")).otherwise(F.col("bh") - 1))
    own = c.select(F.col("b0").alias("_b"), F.col("lo").alias("_pos"), F.lit(0).alias("_kind"), key)
    carry = c.where(F.col("b1") > F.col("b0")).select(
        F.explode(F.sequence(F.col("b0") + 1, F.col("b1"))).alias("_b"), key) \
        .select("_b", F.get(starts, F.col("_b")).alias("_pos"), F.lit(0).alias("_kind"), key)

    d = bucketize(draws.withColumn("_pos", F.col(x_col).cast("double")), "_pos", splits, "_b") \
        .withColumn("_kind", F.lit(1))
    merged = d.unionByName(own, allowMissingColumns=True).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy("_b").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    res = merged.withColumn("_hit", F.last(F.col(key), ignorenulls=True).over(w)) \
        .where(F.col("_kind") == 1)
    return res.drop(key).withColumnRenamed("_hit", key).drop("_b", "_pos", "_kind")
