"""Synthetic decaying matrices A = D·G, B = D·G' and the diagonal scaling D.

G has standard Gaussian entries; D_ii = 1/(i+1)^alpha.  Entries are hashed
from (seed, mat, row, col), so a lost partition regenerates the same values
and the result does not depend on the partition count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.functions.hashing import gaussian


def scale_rows(cells: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Multiply row r by 1/(r+1)^alpha (the diagonal D)."""
    return cells.withColumn("val", F.col("val") * F.pow(F.col("row") + F.lit(1.0), F.lit(-float(alpha))))


def decay_matrix(spark: SparkSession, rows: int, cols: int, alpha: float = 1.0, seed: int = 0,
                 num_partitions: int | None = None) -> DataFrame:
    """Cells of A and B (rows x cols each), no join: one ``range`` over row*cols+col."""
    n = int(rows) * int(cols)
    ids = spark.range(0, n, 1, num_partitions) if num_partitions else spark.range(0, n)
    base = ids.select((F.col("id") / F.lit(int(cols))).cast("bigint").alias("row"),
                      (F.col("id") % F.lit(int(cols))).alias("col"))
    pair = base.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("mat"), "row", "col")
    g = gaussian(seed, "decay", F.col("mat"), F.col("row"), F.col("col"))
    return scale_rows(pair.withColumn("val", g), alpha).select("mat", "row", "col", "val")


def decay_vecs(cells: DataFrame) -> DataFrame:
    """Column-grouped (vecs) layout of a generated pair, rows in order.

    Only for generated matrices, whose columns have ``rows`` entries by
    construction (bounded per record).
    """
    return cells.groupBy("mat", "col").agg(
        F.sort_array(F.collect_list(F.struct("row", "val"))).alias("e")) \
        .select("mat", "col", F.col("e.val").alias("vec"))


def decay_vecs_direct(spark: SparkSession, rows: int, cols: int, alpha: float = 1.0, seed: int = 0,
                      num_partitions: int | None = None) -> DataFrame:
    """A2: the same pair generated column-grouped, (mat, col, vec[rows]),
    with no shuffle: each record computes its column from the hashed rule
    (identical values to ``decay_matrix``)."""
    ids = spark.range(0, 2 * int(cols), 1, num_partitions) if num_partitions else spark.range(0, 2 * int(cols))
    base = ids.select(F.when(F.col("id") < int(cols), F.lit("A")).otherwise(F.lit("B")).alias("mat"),
                      (F.col("id") % F.lit(int(cols))).alias("col"))
    vec = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(int(rows) - 1).cast("bigint")),
                      lambda r: gaussian(seed, "decay", F.col("mat"), r, F.col("col"))
                      * F.pow(r + F.lit(1.0), F.lit(-float(alpha))))
    return base.select("mat", "col", vec.alias("vec"))
