"""Explicit handling of hot keys in the joins on shared keys.

A row (order, hour) or a column may hold a large share of all cells.  A
plain hash join sends every cell of that key to one task.  Here:

1. ``hot_keys`` counts cells per key (a partial + final aggregate) and keeps
   keys with more than ``max(total/parts, min_rows)`` cells.  There are at
   most ``parts`` of them, so the list collected to the driver and the
   broadcast built from it are bounded by ``parts``, not by the data.
2. ``salted_join`` spreads a hot key's cells of the big side over
   ``n_salt`` sub-keys (hash of another column, deterministic) and
   replicates only the hot keys of the other side ``n_salt`` times.

3. Where both sides of a join have many rows of a key, the work is the
   product of both counts.  ``hot_products`` finds keys by that product,
   whichever side makes it large, and ``grid_join`` lays their pairs out on
   a grid: the left side's rows are dealt over its lines, the right side's
   over its columns, and each is replicated along the other direction.

Cold keys keep salt 0, so for data without hot keys this is an ordinary
equi-join with one extra constant column.  AQE's runtime skew splitting
stays on as a second line of defence.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MIN_ROWS = 200_000
#: Classes of keys that are counted before the keys themselves.
CLASSES = 1 << 16
#: Pairs that one task of a join by row makes, about.
TASK_PAIRS = 2_000_000


def _parts(df: DataFrame) -> int:
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_keys(df: DataFrame, key: str, parts: int | None = None, min_rows: int = DEFAULT_MIN_ROWS) -> list:
    """[(key value, n_salt)] for keys holding more than their fair share."""
    return hot_keys_many(df, [key], parts, min_rows)[key]


def hot_counted(counts: DataFrame, key: str, parts: int | None = None, min_rows: int = DEFAULT_MIN_ROWS) -> tuple[int, list]:
    """All rows, and ``hot_keys``, from (key, _n), the rows of every key, where these have been counted already."""
    parts = parts or _parts(counts)
    total = counts.agg(F.sum("_n")).first()[0] or 0
    threshold = max(int(min_rows), int(math.ceil(total / parts)))
    if total <= threshold:
        return total, []
    hot = counts.where(F.col("_n") > threshold).limit(parts + 1).collect()
    return total, [(r[key], int(math.ceil(r["_n"] / threshold))) for r in hot]


def salt_table(spark, key: str, hot: list, key_type: str = "bigint") -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n in hot], f"{key} {key_type}, _nsalt int")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], key: str, hot: list, spread_by: str,
                how: str = "inner") -> DataFrame:
    """``big ⋈ small`` on ``on`` (which contains ``key``), with hot values of
    ``key`` spread over sub-keys.  ``spread_by`` is a column of ``big`` whose
    hash picks the sub-key (e.g. the other index of a cell)."""
    if not hot:
        return big.join(small, on, how)
    spark = big.sparkSession
    dtype = dict(big.dtypes)[key]
    salts = F.broadcast(salt_table(spark, key, hot, dtype))  # <= parts rows
    b = big.join(salts, key, "left").withColumn(
        "_salt", F.when(F.col("_nsalt").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(F.col(spread_by)), F.col("_nsalt")).cast("int"))).drop("_nsalt")
    s = small.join(salts, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_nsalt"), F.lit(1)) - 1))).drop("_nsalt")
    return b.join(s, list(on) + ["_salt"], how).drop("_salt")


def hot_keys_many(df: DataFrame, keys: list[str], parts: int | None = None,
                  min_rows: int = DEFAULT_MIN_ROWS) -> dict:
    """``hot_keys`` for several key columns of one frame in one aggregation:
    every row is counted once under each key (explode), so a side's hot rows
    and hot columns cost one pass instead of one per key.  Keys themselves are
    counted only in classes that have enough rows for a hot one."""
    parts = parts or _parts(df)
    total = df.count()
    threshold = max(int(min_rows), int(math.ceil(total / parts)))
    if total <= threshold:
        return {k: [] for k in keys}
    tagged = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kn"), F.col(k).cast("bigint").alias("kv")) for k in keys])).alias("t")) \
        .select("t.kn", "t.kv", F.pmod(F.xxhash64("t.kv"), F.lit(CLASSES)).alias("_class"))
    # a key has no more rows than its class of keys, and classes take next to no exchange
    full = tagged.groupBy("kn", "_class").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > threshold).collect()  # keys * parts at most
    if not full:
        return {k: [] for k in keys}
    inside = F.lit(False)
    for k in keys:
        inside = inside | ((F.col("kn") == k) & F.col("_class").isin([r["_class"] for r in full if r["kn"] == k]))
    counts = tagged.where(inside).groupBy("kn", "kv").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > threshold).limit(len(keys) * parts + 1).collect()
    out = {k: [] for k in keys}
    for r in hot:
        out[r["kn"]].append((r["kv"], int(math.ceil(r["_n"] / threshold))))
    return out


def hot_products(left: DataFrame, right: DataFrame, key: str, parts: int | None = None,
                 min_pairs: int = DEFAULT_MIN_ROWS, found: dict | None = None) -> list:
    """[(key value, lines, columns)] for keys whose pairs are more than a
    task's fair share of all pairs.  At most ``parts`` keys.  Both sides are
    read once, and again only where there is such a key.  ``found`` is told
    the number of ``tasks`` that all pairs ask for."""
    parts = parts or _parts(left)
    ones = lambda df, l, r: df.select(key, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    counts = ones(left, 1, 0).unionAll(ones(right, 0, 1)).groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")) \
        .where(F.col(key).isNotNull() & (F.col("_l") > 0) & (F.col("_r") > 0)).withColumn("_w", F.col("_l").cast("double") * F.col("_r"))
    total, most = counts.agg(F.sum("_w"), F.max("_w")).first()
    if found is not None:
        found["tasks"] = max(parts, math.ceil((total or 0.0) / TASK_PAIRS))
    share = max(float(min_pairs), (total or 0.0) / parts)
    if (most or 0.0) <= share:  # the usual case: both sides have been read once
        return []
    out = []
    for r in counts.where(F.col("_w") > share).limit(parts + 1).collect():
        pieces = math.ceil(r["_w"] / share)
        lines = min(r["_l"], max(1, round(math.sqrt(pieces * r["_l"] / r["_r"]))))
        out.append((r[key], int(lines), int(min(r["_r"], math.ceil(pieces / lines)))))
    return out


def grid_join(left: DataFrame, right: DataFrame, key: str, spread_left: str, spread_right: str, hot: list,
              tasks: int | None = None) -> DataFrame:
    """``left ⋈ right`` on ``key`` with the pairs of hot keys laid out on grids, in ``tasks`` tasks if given: adaptive
    execution sizes tasks by the rows they read, of which a few MB may make many pairs."""
    def dealt(df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(tasks, *keys) if tasks else df

    if not hot:
        return dealt(left, key).join(dealt(right, key), key)
    grid = F.broadcast(left.sparkSession.createDataFrame(hot, f"{key} {dict(left.dtypes)[key]}, _lines int, _columns int"))  # <= parts rows

    def laid(df: DataFrame, spread: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        return df.join(grid, key, "left") \
            .withColumn(own, F.when(F.col(own_n).isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col(own_n))).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other_n), F.lit(1)) - 1))).drop("_lines", "_columns")

    a = laid(left, spread_left, "_line", "_column", "_lines", "_columns")
    b = laid(right, spread_right, "_column", "_line", "_columns", "_lines")
    on = [key, "_line", "_column"]
    return dealt(a, *on).join(dealt(b, *on), on)
