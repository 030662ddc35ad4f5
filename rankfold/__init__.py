"""rankfold: low-rank approximation of matrix products AᵀB on Spark.

Matrices are ordinary DataFrames of cells ``(mat, row, col, val)``; every
operator returns a DataFrame that Catalyst plans and Spark distributes.
"""

from rankfold.session import build_session, cut_lineage, ensure_checkpoint_dir

__all__ = ["build_session", "cut_lineage", "ensure_checkpoint_dir"]
