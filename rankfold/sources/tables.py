"""Cells from ordinary tables (ours: the reference only generates data).

A matrix pair is one DataFrame ``cells(mat STRING, row BIGINT, col BIGINT,
val DOUBLE)`` with ``mat`` in {'A', 'B'}; A and B share the row space.
Cells are unique per ``(mat, row, col)``: tables may repeat a cell (e.g.
one order buying the same part twice), so every adapter sums first,
otherwise squared column norms would be wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.session import cut_lineage

CELL_COLUMNS = ["mat", "row", "col", "val"]

#: Cells that one task adds up, about: a hash table of some 100 MB.
TASK_CELLS = 1_000_000


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def cells_from_table(df: DataFrame, row, col, val, mat: str | Column = "A") -> DataFrame:
    """One matrix from a table: (row key, column key, value), summed per cell."""
    out = df.select(
        (F.lit(mat) if isinstance(mat, str) else mat).alias("mat"),
        _c(row).cast("bigint").alias("row"),
        _c(col).cast("bigint").alias("col"),
        _c(val).cast("double").alias("val"),
    ).where(F.col("row").isNotNull() & F.col("col").isNotNull() & F.col("val").isNotNull())
    return out.groupBy("mat", "row", "col").agg(F.sum("val").alias("val"))


def cells_pair_from_table(df: DataFrame, row, col_a, col_b, val) -> DataFrame:
    """A and B from the same table in ONE scan: each input row yields an A cell
    (row, col_a) and a B cell (row, col_b); one aggregation dedupes both."""
    return _pair(df, row, col_a, col_b, val)[0]


def stored_pair_from_table(df: DataFrame, row, col_a, col_b, val) -> tuple[DataFrame, bool]:
    """The cells of :func:`cells_pair_from_table` written below the checkpoint folder, where they take less disk than a
    persisted frame and the exchange behind it; and whether they lie in buckets of their row (not where a row is hot)."""
    from rankfold.operators.factorize import bucketed

    cells, tasks, by_row = _pair(df, row, col_a, col_b, val)
    return (bucketed(cells, "row", tasks, dealt=True)[0] if by_row else cut_lineage(cells)), by_row


def _pair(df: DataFrame, row, col_a, col_b, val) -> tuple[DataFrame, int, bool]:
    """The cells, the tasks that add them up, and whether a row's cells lie in one task.

    Rows are exchanged before they are added up, as few cells repeat: adding up before the exchange would save none of
    it, while its hash table grows with the part of a file that a task scans.  They are dealt by their row key, before a
    row becomes two cells; where a row key has more cells than a task's, by cell.
    """
    from rankfold.operators.skew import hot_keys

    plain = df.select(_c(row).cast("bigint").alias("row"), _c(val).cast("double").alias("val"),
                      _c(col_a).cast("bigint").alias("_a"), _c(col_b).cast("bigint").alias("_b")) \
        .where(F.col("row").isNotNull() & F.col("val").isNotNull())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, -(-2 * df.count() // TASK_CELLS))
    by_row = not hot_keys(plain, "row", tasks, TASK_CELLS // 2)
    pairs = (plain.repartition(tasks, "row") if by_row else plain).select("row", "val", F.explode(F.array(
        F.struct(F.lit("A").alias("mat"), F.col("_a").alias("col")),
        F.struct(F.lit("B").alias("mat"), F.col("_b").alias("col")),
    )).alias("c"))
    out = pairs.select(F.col("c.mat").alias("mat"), "row", F.col("c.col").alias("col"), "val").where(F.col("col").isNotNull())
    dealt = out if by_row else out.repartition(tasks, "mat", "row", "col")
    return dealt.groupBy("mat", "row", "col").agg(F.sum("val").alias("val")), tasks, by_row


def cells_from_vectors(df: DataFrame, id_col, vec_col, mat: str | Column = "A") -> DataFrame:
    """Vector i (length d) becomes column i; its coordinates are rows 0..d-1.

    A projection only (posexplode): no shuffle.  Vectors are unique by id.
    """
    m = F.lit(mat) if isinstance(mat, str) else mat
    return df.select(m.alias("mat"), _c(id_col).cast("bigint").alias("col"),
                     F.posexplode(_c(vec_col)).alias("pos", "v")) \
        .select("mat", F.col("pos").cast("bigint").alias("row"), "col",
                F.col("v").cast("double").alias("val"))


def vecs_from_table(df: DataFrame, id_col, vec_col, mat: str | Column = "A") -> DataFrame:
    """Column-grouped form ``vecs(mat, col, vec ARRAY<DOUBLE>)``."""
    m = F.lit(mat) if isinstance(mat, str) else mat
    return df.select(m.alias("mat"), _c(id_col).cast("bigint").alias("col"),
                     _c(vec_col).cast("array<double>").alias("vec"))


def split(cells: DataFrame):
    """(A, B) views of a pair: A as (row, i, a), B as (row, j, b)."""
    a = cells.where(F.col("mat") == "A").select("row", F.col("col").alias("i"), F.col("val").alias("a"))
    b = cells.where(F.col("mat") == "B").select("row", F.col("col").alias("j"), F.col("val").alias("b"))
    return a, b
