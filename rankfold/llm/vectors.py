"""Operator 9, near-duplicate vectors by an exact metric range join.

Vectors are scaled to length one in double precision; a cosine of at least c is then a Euclidean
distance of at most eps = sqrt(2 - 2c), a metric.

1. Equal vectors (bit by bit) form a class; one of a class is compared, and its copies are counted.
2. Pivots, a bounded sample by hash, partition the vectors: a vector's cell is that of its nearest
   pivot p.  If u has its cell at q and |u - v| <= eps, then by the triangle inequality
   |v - q| <= |u - q| + eps and |u - q| <= |u - p| <= |v - p| + eps, so |v - q| <= |v - p| + 2 eps, and in
   Euclidean space the distance of v from the plane halfway between p and q is at most eps.  v is
   replicated to just the cells that pass both tests (with a margin for rounding).
3. Of two cells one is chosen, by their numbers, for the pairs between them: only its vectors stay at home, the
   other's are replicated to it, so a pair is looked at in exactly one cell.  Cells are cut into blocks of bounded
   size, and each two blocks that hold home vectors meet in a task of their own, once, so a hot cell is spread.
4. A task bounds all its cosines by a product of ``HEAD`` columns: the coordinates along the main axes of its
   vectors, and the length of what is left of each (Cauchy-Schwarz).  Pairs that pass are computed in double precision.
5. A task counts the links of each vector, weighted by copies, and gives a spanning forest of them; no
   pairs are put out.  Components follow.

There is a pivot for each ``CELL`` vectors, up to ``MAX_PIVOTS``; beyond, cells grow and are cut into more
blocks.  How much the pivots save depends on the data: where distances hardly differ (many dimensions and
no clusters) most vectors are replicated to half the cells.  All pairs are then bounded, and a vector is exchanged
once for each block of ``HOME_BLOCK`` vectors (``LEAST_BLOCKS`` times in smaller tables, for tasks enough).

Defined cases: vectors that are null, empty, zero, or have null or non-finite components, link with
nothing (0 links, a component of their own); vectors of different lengths don't link; rows with the same
id are one vector for components, and each is a copy where its components agree; a null id has a null
component, links with nothing and is not kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import discard, map_arrow, stored
from rankfold.llm.components import components

MAX_PIVOTS = 1024
#: Home vectors and replicas that meet in one task at most, and vectors for each pivot.
HOME_BLOCK, ROW_BLOCK, CELL = 65536, 65536, 65536
#: Bytes of such a block at most; blocks that a table is cut into, unless they get smaller than the least block.
BLOCK_BYTES, LEAST_BLOCKS, LEAST_BLOCK = 32 << 20, 8, 1024
TASKS = 50_000
MARGIN = 1e-9
#: Columns of the bound on cosines, what rounding to float32 may take from it, and vectors bounded at a time.
HEAD, SLACK, CHUNK = 16, 1e-5, (512, 4096)


def unit_rows(raw: list) -> tuple[list[int], np.ndarray]:
    """Positions and unit vectors of the usable of some equally long vectors."""
    m = np.array(raw, dtype=np.float64)
    with np.errstate(all="ignore"):
        scaled = m / np.abs(m).max(axis=1, keepdims=True) if m.size else m  # no overflow for very large or small components
        norm = np.sqrt(np.einsum("ij,ij->i", scaled, scaled))
        good = np.isfinite(m).all(axis=1) & np.isfinite(norm) & (norm > 0)
        return np.flatnonzero(good).tolist(), (scaled / norm[:, None])[good]


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, cls and the unit vector as doubles in bytes (null where it can link with nothing)."""
    frame = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))

    def make():
        def step(cols):
            ids, rows = cols["vec_id"].to_pylist(), cols["v"].to_pylist()
            cls, unit = [None] * len(ids), [None] * len(ids)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                if v and None not in v:
                    by_length.setdefault(len(v), []).append(i)
            for own in by_length.values():
                good, units = unit_rows([rows[i] for i in own])
                for g, u in zip(good, units):
                    raw = np.array(rows[own[g]], dtype=np.float64) + 0.0  # no negative zeros
                    cls[own[g]], unit[own[g]] = xxhash.xxh3_128_hexdigest(raw.tobytes()), u.tobytes()
            yield {"vec_id": ids, "cls": cls, "unit": unit}

        return step

    return map_arrow(frame, make, "vec_id bigint, cls string, unit binary")


def cells_of(units: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector, and which cells each must be in."""
    d2 = np.maximum(0.0, (units ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None, :] - 2 * units @ pivots.T)
    home = d2.argmin(axis=1)
    at = np.arange(len(units))
    d = np.sqrt(d2)
    apart = _apart(pivots)[home]
    triangle = d <= d[at, home][:, None] + 2 * eps + MARGIN
    plane = d2 - d2[at, home][:, None] <= 2 * apart * (eps + MARGIN) + MARGIN
    inside = triangle & plane
    inside[at, home] = True
    return home, inside


def _apart(pivots: np.ndarray) -> np.ndarray:
    g = pivots @ pivots.T
    n = np.diag(g)
    return np.sqrt(np.maximum(0.0, n[:, None] + n[None, :] - 2 * g))


def chosen_cells(home: np.ndarray, n_cells: int) -> np.ndarray:
    """Cells that the vectors of a home may be replicated to: of two cells the lower one if the sum of their numbers is even, else the higher one."""
    cell, h = np.arange(n_cells)[None, :], home[:, None]
    return (cell != h) & ((cell < h) == ((cell + h) % 2 == 0))


def near_pairs(m: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``m`` (unit vectors) of the pairs with a cosine of at least ``cosine`` between two blocks, or within the one block, each pair once."""
    within, dim = right is None, m.shape[1]
    right = left if within else right
    bound = None
    if dim > HEAD:
        axes = np.linalg.eigh(m.T @ m)[1][:, 1 - HEAD:]
        head = m @ axes
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", head, head)))
        bound = np.column_stack([head, rest]).astype(np.float32)
    for i in range(0, len(left), CHUNK[0]):
        x = left[i:i + CHUNK[0]]
        for j in range(i if within else 0, len(right), CHUNK[1]):
            y = right[j:j + CHUNK[1]]
            at, size = None, len(x) * len(y)
            if bound is not None:
                at = np.flatnonzero(bound[x] @ bound[y].T >= np.float32(cosine - SLACK))
            if at is None or len(at) * dim > 2 * size:  # the whole product costs less
                at = np.flatnonzero(m[x] @ m[y].T >= cosine)
                a, b = np.divmod(at, len(y))
            else:
                a, b = np.divmod(at, len(y))
                near = np.einsum("ij,ij->i", m[x[a]], m[y[b]]) >= cosine
                a, b = a[near], b[near]
            if within:
                once = i + a < j + b
                a, b = a[once], b[once]
            if len(a):
                yield x[a], y[b]


def bound_together(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's tree, after the trees of ``a`` and ``b`` have been joined pair by pair."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def meetings(placed: DataFrame, n: int) -> tuple[DataFrame, int, DataFrame]:
    """(dim, cell, a, b, block, rep, copies, unit), a row for each meeting of a vector: blocks a and b of a cell meet, and
    the vector is of one of them.  Then the number of these meetings, and the stored number of blocks of each cell.

    Home blocks are numbered from 0, blocks of replicas after them; a <= b, and a is a home block.
    """
    cells = placed.select("dim", "cell", F.lit(1).alias("home")).union(placed.select("dim", F.explode("others").alias("cell"), F.lit(0).alias("home")))
    few = max(LEAST_BLOCK, -(-n // LEAST_BLOCKS))

    def blocks(number, most):
        of_bytes = F.floor(F.lit(BLOCK_BYTES // 8) / F.col("dim"))
        return F.ceil(number / F.greatest(F.lit(1), F.least(F.lit(min(most, few)), of_bytes))).cast("int")

    # a cell whose pivot has an earlier twin has no home vectors, so no pairs
    sizes = stored(cells.groupBy("dim", "cell").agg(blocks(F.sum("home"), HOME_BLOCK).alias("n_home"), blocks(F.sum(1 - F.col("home")), ROW_BLOCK).alias("n_rows"))
                   .where("n_home > 0"), "sizes")
    tasks = sizes.agg(F.sum(F.expr("n_home * (n_home + 1L) / 2 + n_home * CAST(n_rows AS long)"))).first()[0] or 1
    carried = ("rep", "copies", "unit")
    bucket = lambda number: F.pmod(F.xxhash64("rep", "unit"), F.col(number)).cast("int")
    home = placed.join(sizes, ["dim", "cell"]).select("dim", "cell", bucket("n_home").alias("block"), F.explode(F.expr("sequence(0, n_home + n_rows - 1)")).alias("o"), *carried)
    replicas = placed.select("dim", F.explode("others").alias("cell"), *carried).join(sizes, ["dim", "cell"]).select(
        "dim", "cell", F.explode(F.expr("sequence(0, n_home - 1)")).alias("a"), (F.col("n_home") + bucket("n_rows")).alias("block"), *carried)
    return home.select("dim", "cell", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "block", *carried).union(
        replicas.select("dim", "cell", "a", F.col("block").alias("b"), "block", *carried)), int(tasks), sizes


def near_vectors(vectors: DataFrame, cosine: float = 0.95, max_pivots: int = MAX_PIVOTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    spark = vectors.sparkSession
    rows = stored(unit_vectors(vectors, id_col, vec_col), "units")
    good = rows.where("cls IS NOT NULL AND vec_id IS NOT NULL")
    # repeated rows of an id are one vector
    classes = stored(good.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"),
                                             F.first("unit").alias("unit")), "vectors")
    n = classes.count()
    wanted = int(min(max_pivots, max(1, -(-n // CELL))))
    sample = classes.select("unit", "cls").orderBy(F.xxhash64("cls"), "cls").limit(wanted).collect()  # at most max_pivots vectors
    by_length: dict[int, list] = {}
    for r in sample:
        u = np.frombuffer(bytes(r["unit"]))
        by_length.setdefault(len(u), []).append(u)
    pivots = {k: np.array(v) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(pivots)

    def make():
        def step(cols):
            out = {c: [] for c in ("dim", "cell", "others", "rep", "copies", "unit")}
            rep, copies = cols["rep"].to_pylist(), cols["copies"].to_pylist()
            units = [u.as_py() for u in cols["unit"]]
            lengths = np.array([len(u) // 8 for u in units])
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                for a in range(0, len(own), 2048):
                    part = own[a:a + 2048]
                    m = np.frombuffer(b"".join(units[i] for i in part)).reshape(len(part), dim)
                    ps = shared.value.get(int(dim))
                    home, inside = cells_of(m, ps, eps) if ps is not None else (np.zeros(len(part), int), np.ones((len(part), 1), bool))
                    inside &= chosen_cells(home, inside.shape[1])
                    for j, h, others in zip(part, home, inside):
                        for name, v in zip(out, (int(dim), int(h), np.flatnonzero(others), rep[j], copies[j], units[j])):
                            out[name].append(v)
            yield out

        return step

    placed = stored(map_arrow(classes, make, "dim int, cell int, others array<int>, rep bigint, copies bigint, unit binary"), "cells")
    met_in, tasks, sizes = meetings(placed, n)
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def meet(found: pa.Table) -> pa.Table:
        """Links of the vectors of two blocks, or within the one block."""
        rep, copies, block = found["rep"].to_numpy(), found["copies"].to_numpy(), found["block"].to_numpy()
        m = np.frombuffer(b"".join(u.as_py() for u in found["unit"])).reshape(len(rep), -1)
        a, b = found["a"][0].as_py(), found["b"][0].as_py()
        links = np.zeros(len(rep), dtype=np.int64)
        ids, node = np.unique(rep, return_inverse=True)
        root, waiting, n_waiting = np.arange(len(ids)), [], 0
        for x, y in near_pairs(m, np.flatnonzero(block == a), None if a == b else np.flatnonzero(block == b), cosine):
            other = rep[x] != rep[y]  # an id's own classes are bound through the id
            x, y = x[other], y[other]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            waiting.append((node[x], node[y]))
            n_waiting += len(x)
            if n_waiting > len(rep):
                root, waiting, n_waiting = bound_together(root, *map(np.concatenate, zip(*waiting))), [], 0
        if waiting:
            root = bound_together(root, *map(np.concatenate, zip(*waiting)))
        total = np.zeros(len(ids), dtype=np.int64)
        np.add.at(total, node, links)
        some = total > 0
        return pa.table({"rep": ids[some], "root": ids[root][some], "links": total[some]}, schema=schema)

    key = ("dim", "cell", "a", "b")
    met = stored(met_in.repartition(min(TASKS, tasks), *key).groupBy(*key).applyInArrow(meet, "rep bigint, root bigint, links bigint"), "met")
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    twice = good.select("vec_id", "cls").join(classes.select("cls", "rep"), "cls").groupBy("vec_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("reps")).where("a <> b")
    edges = met.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).union(twice.select("a", F.explode("reps").alias("b")))
    labels = components(edges).select(F.col("id").alias("rep"), F.col("component_id").alias("label"))
    discard(placed, sizes)
    own = classes.select("cls", "rep", "copies").join(counts, "rep", "left").join(labels, "rep", "left").select(
        "cls", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("label", "rep").alias("label"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("cls")).alias("cls")).join(own, "cls", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("label", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
