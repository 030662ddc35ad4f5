"""Connected components of a graph given as an edge table; everything stays in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import discard, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (a long, b long), with the smallest id of its component.

    Each round hooks a node and its parent to the grandparents of its neighbours and halves the paths,
    so the number of rounds grows with the logarithm of the longest path.  Rounds cut their lineage by
    written tables.  Only minima are gathered for a node, so a hub is no hot group.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = stored(both, "links")
    # a node starts below its smallest neighbour
    parents = stored(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("f")).select(F.col("a").alias("u"), "f"), "parents")
    for _ in range(max_rounds):
        up = parents.select(F.col("u").alias("f"), F.col("f").alias("g"))
        grand = parents.join(up, "f").select("u", "f", "g")  # every parent is a node
        seen = links.join(grand.select(F.col("u").alias("b"), F.col("g").alias("h")), "b").groupBy("a").agg(F.min("h").alias("h"))
        near = grand.join(seen.select(F.col("a").alias("u"), "h"), "u")
        offers = near.select(F.col("f").alias("u"), "h").union(near.select("u", F.least("h", "g").alias("h")))
        best = offers.groupBy("u").agg(F.min("h").alias("h"))
        after = parents.join(best, "u", "left").select("u", F.least("f", F.coalesce("h", "f")).alias("g"), F.col("f").alias("old"))
        new = stored(after, "parents")
        changed = new.where("g <> old").limit(1).count()
        discard(parents)
        parents = new.select("u", F.col("g").alias("f"))
        parents._llm_path = new._llm_path
        if not changed:
            discard(links)
            return parents.select(F.col("u").alias("id"), F.col("f").alias("component_id"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
