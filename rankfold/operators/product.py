"""Exact products: the full AᵀB, sampled cells of it, mask and transpose.

Join strategy is left to Catalyst/AQE: sort-merge on the row key with
runtime skew splitting (a heavy row's cells are split across tasks and the
other side replicated), broadcast when one side is small at runtime.
Aggregation after the join is partial (map-side combine) then final.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.session import freed_shuffles
from rankfold.sources.tables import split


def product_exact(cells: DataFrame, detect_skew: bool = True, min_rows: int = 200_000) -> DataFrame:
    """M = AᵀB as cells (i, j, val); only non-empty cells are produced.

    Work is sum over rows of nnzA(row)·nnzB(row): meant for sparse data
    and for checks; the pipelines never form M.  A row with many pairs,
    whichever side they come from, is laid out on a grid of tasks.
    """
    from rankfold.operators.skew import grid_join, hot_products

    a, b = split(cells)
    found: dict = {}
    hot = hot_products(a, b, "row", min_pairs=min_rows, found=found) if detect_skew else []
    return grid_join(a, b, "row", "i", "j", hot, found.get("tasks")).drop("_line", "_column").groupBy("i", "j") \
        .agg(F.sum(F.col("a") * F.col("b")).alias("val"))


def transpose(df: DataFrame, left: str = "i", right: str = "j") -> DataFrame:
    """Swap the two index columns (Mᵀ, samplesᵀ)."""
    tmp = "__t"
    return df.withColumnRenamed(left, tmp).withColumnRenamed(right, left).withColumnRenamed(tmp, right)


def mask(cells_ij: DataFrame, samples: DataFrame) -> DataFrame:
    """Keep only sampled cells (unsampled cells are implicit zeros)."""
    return cells_ij.join(samples.select("i", "j"), ["i", "j"], "left_semi")


def value_exact(cells: DataFrame, samples: DataFrame, first: str = "A", detect_skew: bool = True,
                min_rows: int = 200_000, columns: DataFrame | None = None, by_row: bool = False) -> DataFrame:
    """Second pass: exact M[i, j] for every sampled (i, j); zeros kept.

    Three plans, all exact (``first``):

    * 'A': samples ⋈ A on i (only sampled columns), then ⋈ B on (row, j);
      work sum_i S_i·nnz(A_i).
    * 'B': the same from B; work sum_j S_j·nnz(B_j).
    * 'rows': pairs of A and B cells sharing a row, kept only where (i, j)
      was sampled; work sum_row nnzA(row)·nnzB(row) (best when rows are
      short, e.g. orders with a few lines).
    * 'auto': the cheapest of the three by those counts (choose_plan).

    Both sides pass a Bloom sieve of the sampled columns first, so that cells
    of other columns are dropped where they are scanned ('auto': a side with
    over half its cells in sampled columns goes without, as that would cost
    more than it saves).  Hot keys of both
    joins are salted (their cells spread over sub-keys, the other side
    replicated): hot columns in the first, hot rows in the second, where a
    (row, j) meets at most as many cells as the row has on the first side.
    The result is left-joined back to the samples so cells whose value is 0
    stay observed; pairs of 'rows' meet the samples as packs (operators.pairs).

    ``columns`` are the cells' numbers (mat, col, nnz) where they have been counted; ``by_row`` says that the cells lie
    in buckets of their row, where pairs are made without an exchange.
    """
    from rankfold.operators.pairs import sampled_sums
    from rankfold.operators.skew import grid_join, hot_keys_many, hot_products, salted_join

    s = samples.select("i", "j")
    kept, found = {"A": 0.0, "B": 0.0}, {}
    if first == "auto":
        first, kept = choose_plan(cells, s, columns, found)
    a, b = sampled_sides(cells, s, kept["A"] <= 0.5, kept["B"] <= 0.5)
    if first == "A":
        hot = hot_keys_many(a, ["i", "row"], min_rows=min_rows) if detect_skew else {"i": [], "row": []}
        part = salted_join(salted_join(a, s, ["i"], "i", hot["i"], "row"), b, ["row", "j"], "row", hot["row"], "i")
    elif first == "B":
        hot = hot_keys_many(b, ["j", "row"], min_rows=min_rows) if detect_skew else {"j": [], "row": []}
        part = salted_join(salted_join(b, s, ["j"], "j", hot["j"], "row"), a, ["row", "i"], "row", hot["row"], "j")
    elif first == "rows":
        hot = []
        if detect_skew and not no_hot_row(cells, found, kept, min_rows):
            hot = hot_products(a, b, "row", min_pairs=min_rows, found=found)
        tasks = found.get("tasks")
        pairs = grid_join(a, b, "row", "i", "j", hot, None if by_row and not hot else tasks)
        return sampled_sums(pairs.select("i", "j", "a", "b"), samples, tasks or 1)
    else:
        raise ValueError("first must be 'A', 'B', 'rows' or 'auto'")
    dots = part.groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("val"))
    return samples.join(dots, ["i", "j"], "left").withColumn("val", F.coalesce(F.col("val"), F.lit(0.0)))


def sampled_sides(cells: DataFrame, samples: DataFrame, sieve_a: bool = True, sieve_b: bool = True) -> tuple[DataFrame, DataFrame]:
    """A's cells (row, i, a) and B's (row, j, b); a sieved side has those of sampled columns, but for a few others let through."""
    from rankfold.operators.sieve import sieved

    a, b = split(cells)
    return sieved(a, "i", samples) if sieve_a else a, sieved(b, "j", samples) if sieve_b else b


def no_hot_row(cells: DataFrame, found: dict, kept: dict, min_pairs: int) -> bool:
    """Whether choose_plan's counts show that no row has more than a task's share of the pairs of unsieved sides."""
    from rankfold.operators.skew import TASK_PAIRS, _parts

    if "pairs" not in found or kept["A"] <= 0.5 or kept["B"] <= 0.5:
        return False
    parts = _parts(cells)
    found["tasks"] = max(parts, math.ceil(found["pairs"] / TASK_PAIRS))
    return found["most"] <= max(float(min_pairs), found["pairs"] / parts)


def choose_plan(cells: DataFrame, samples: DataFrame, columns: DataFrame | None = None, found: dict | None = None) -> tuple[str, dict]:
    """value_exact's cheapest plan by three work estimates, and the share of
    each side's cells that lie in sampled columns (two small aggregate jobs;
    only these numbers reach the driver).  ``found`` is told the ``pairs`` of
    all rows and the ``most`` of one row."""
    drawn = samples.select(F.explode(F.array(F.struct(F.lit("A").alias("mat"), F.col("i").alias("col")),
                                             F.struct(F.lit("B").alias("mat"), F.col("j").alias("col")))).alias("c")) \
        .groupBy("c.mat", "c.col").agg(F.count(F.lit(1)).alias("drawn"))
    counted = cells.groupBy("mat", "col").agg(F.count(F.lit(1)).alias("n")) if columns is None else columns.select("mat", "col", F.col("nnz").alias("n"))
    columns = counted.join(drawn, ["mat", "col"], "left")
    with freed_shuffles(cells.sparkSession):
        sides = {r["mat"]: r for r in columns.groupBy("mat").agg(
            F.sum(F.col("n").cast("double") * F.coalesce("drawn", F.lit(0))).alias("work"), F.sum("n").alias("all"),
            F.sum(F.when(F.col("drawn").isNotNull(), F.col("n")).otherwise(0)).alias("kept")).collect()}  # two rows
    per_row = cells.where(F.col("row").isNotNull()).groupBy("row").agg(
        F.sum(F.when(F.col("mat") == "A", 1).otherwise(0)).alias("ra"),
        F.sum(F.when(F.col("mat") == "B", 1).otherwise(0)).alias("rb"))
    made = F.col("ra").cast("double") * F.col("rb")
    with freed_shuffles(cells.sparkSession):
        cr, most = (x or 0.0 for x in per_row.agg(F.sum(made), F.max(made)).first())
    if found is not None:
        found |= {"pairs": cr, "most": most}
    costs = {m: float(sides[m]["work"]) if m in sides else 0.0 for m in "AB"} | {"rows": float(cr)}
    return min(costs, key=costs.get), {m: sides[m]["kept"] / sides[m]["all"] if m in sides else 0.0 for m in "AB"}


def value_exact_vecs(vecs: DataFrame, samples: DataFrame, size: int = 4096) -> DataFrame:
    """D1 for column-grouped (dense) data: columns are cut into chunks of ``size`` numbers, and samples and chunks meet
    on a grid of tiles (operators.tiles), where numpy takes the dot products; the chunks' parts are added up."""
    from rankfold.operators.hadamard import chunked

    return value_exact_chunks(chunked(vecs, size), samples, size)


def value_exact_chunks(chunks: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """The same for columns in chunks (mat, col, chunk, vec); samples are distinct (i, j)."""
    from rankfold.operators.tiles import tiled_dots, with_values

    dots = tiled_dots(samples, chunks, size)
    return with_values(samples, dots.groupBy("i", "j").agg(F.sum("dot").alias("dot"), F.first("rest").alias("rest")), F.col("dot"))
