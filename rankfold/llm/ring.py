"""Shards of documents by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` places of a ring (hashes of shard and place); a document's key, its id, is hashed to
the ring and belongs to the next place clockwise.  A shard takes no more rows than its bound: what overflows it goes
on clockwise, place by place, until a shard has room.  With ``slack`` e a bound is (1 + e) times the mean, rounded up,
and adding a shard moves few rows; with no slack the bounds are the mean rounded down or up, so that all shards are
full and counts are at most one apart.

Rows are counted per arc of the ring (a bounded table: one number per place), the overflow is worked out on those
counts, and rows find their segment by their position along the ring.  Positions come from ranges of the ring, so an
id that a third of all rows share is split like any other rows.

Defined cases: a null text has size 16 and crc32 0, an empty one too; null ids are one key; rows that repeat an id are
ordered by crc32 and size along the ring, and equal rows take any of their slots; an empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.functions.hashing import hash52, py_hash52
from rankfold.llm.common import map_arrow, stored
from rankfold.llm.ranks import placed

SEED = 12
ROW_BYTES = 16


@dataclass
class Ring:
    """``places``: sorted hashes; ``owner``: the shard of each place."""

    places: np.ndarray
    owner: np.ndarray

    def arc(self, hashes: np.ndarray) -> np.ndarray:
        """Arc a lies between the places before and at a; the last one runs on to the first place."""
        return np.searchsorted(self.places, hashes, side="left")


def make_ring(shards: int, points: int, seed: int = SEED) -> Ring:
    at = sorted((py_hash52(seed, "place", s, k), s) for s in range(shards) for k in range(points))
    return Ring(np.array([h for h, _ in at], dtype=np.int64), np.array([s for _, s in at], dtype=np.int64))


def bounds(rows: int, shards: int, slack: float) -> np.ndarray:
    """The most rows of each shard; without slack they add up to ``rows``."""
    if slack < 0:
        raise ValueError("slack below 0: the shards could not hold all rows")
    if slack:
        return np.full(shards, int(np.ceil((1 + slack) * rows / shards)), dtype=np.int64)
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], dtype=np.int64)


def segments(ring: Ring, counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(first row along the ring, shard, first slot) of every stretch of rows that goes to one shard.

    All arcs first fill their own places' shards, then what is left moves on by one place, and so on: a row that has
    travelled less comes first.  The work depends on the places, not on the rows.
    """
    n = len(ring.places)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    waiting = {a: int(c) for a, c in enumerate(counts) if c}
    room, used, out = most.copy(), np.zeros(len(most), dtype=np.int64), []
    placed_of = dict.fromkeys(waiting, 0)
    for step in range(n):
        if not waiting:
            break
        for a in list(waiting):
            s = ring.owner[(a + step) % n]
            take = min(waiting[a], int(room[s]))
            if take:
                out.append((first[a] + placed_of[a], s, used[s]))
                placed_of[a] += take
                room[s] -= take
                used[s] += take
                waiting[a] -= take
                if not waiting[a]:
                    del waiting[a]
    if waiting:
        raise AssertionError("the bounds add up to less than the rows")
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 3)


def assign(docs: DataFrame, shards: int, points: int = 64, slack: float = 0.0, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, travelled) of every row; ``travelled``: its shard isn't the one that its
    key belongs to."""
    ring = make_ring(shards, points, seed)
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit("").cast("binary"))
    keyed = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text).alias("text_crc32"),
        hash52(seed, "key", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))).alias("at")), "keyed")

    def arcs():
        return lambda cols: iter([{"arc": ring.arc(cols["at"].to_numpy())}])

    counts = np.zeros(len(ring.places) + 1, dtype=np.int64)
    for r in map_arrow(keyed.select("at"), arcs, "arc bigint").groupBy("arc").count().collect():  # one row per place at most
        counts[r["arc"]] = r["count"]
    cut = segments(ring, counts, bounds(int(counts.sum()), shards, slack))
    rows, offsets = placed(keyed, [], ["at", "doc_id", "text_crc32", "size"], "along_ring")
    along = rows.join(F.broadcast(offsets), "_range")  # one row per range
    along = along.select("doc_id", "size", "text_crc32", "at", (F.col("_at") + F.col("_offset")).alias("rank"))

    def shard():
        def step(cols):
            rank, at = cols["rank"].to_numpy(), cols["at"].to_numpy()
            k = np.searchsorted(cut[:, 0], rank, side="right") - 1
            own = ring.owner[ring.arc(at) % len(ring.places)]
            yield {"doc_id": cols["doc_id"], "size": cols["size"], "text_crc32": cols["text_crc32"], "shard": cut[k, 1],
                   "slot": cut[k, 2] + rank - cut[k, 0], "travelled": own != cut[k, 1]}
        return step

    return map_arrow(along, shard, "doc_id bigint, size bigint, text_crc32 bigint, shard int, slot bigint, travelled boolean")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rows, moved): of the ids in both assignments, those whose shards differ.  Ids have to be unique."""
    b = before.select("doc_id", F.col("shard").alias("_before"))
    return b.join(after.select("doc_id", F.col("shard").alias("_after")), "doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum((F.col("_before") != F.col("_after")).cast("long")), F.lit(0)).alias("moved"))
