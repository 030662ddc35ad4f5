"""Column norms and Frobenius norms (one scan, partial + final aggregation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.arrays import sum_squares


def col_norms2(cells: DataFrame) -> DataFrame:
    """Squared column norms of A and B in one scan: (mat, col, norm2, nnz)."""
    return cells.groupBy("mat", "col").agg(
        F.sum(F.col("val") * F.col("val")).alias("norm2"),
        F.count(F.lit(1)).alias("nnz"),
    )


def col_norms2_vecs(vecs: DataFrame) -> DataFrame:
    """Column-grouped form: each record already holds a whole column (no shuffle)."""
    return vecs.select("mat", "col", sum_squares(F.col("vec")).alias("norm2"))


def sketch_norms2(sketch: DataFrame) -> DataFrame:
    """Squared norms of sketched columns from the long form (mat, col, t, s)."""
    return sketch.groupBy("mat", "col").agg(F.sum(F.col("s") * F.col("s")).alias("norm2"))


def frobenius2(norms: DataFrame) -> DataFrame:
    """F_A, F_B and the column counts n1, n2: (mat, fro2, n_cols)."""
    return norms.groupBy("mat").agg(F.sum("norm2").alias("fro2"), F.count(F.lit(1)).alias("n_cols"))


def norm_totals(norms: DataFrame) -> dict:
    """Driver-side scalars (F_A, F_B, n1, n2): one 2-row aggregate."""
    rows = {r["mat"]: r for r in frobenius2(norms).collect()}
    a, b = rows.get("A"), rows.get("B")
    return {
        "fro_a": float(a["fro2"]) if a else 0.0, "n1": int(a["n_cols"]) if a else 0,
        "fro_b": float(b["fro2"]) if b else 0.0, "n2": int(b["n_cols"]) if b else 0,
    }
