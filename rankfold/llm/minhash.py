"""Operator 7, near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes (top 63 bits) of its distinct 5-word shingles.  Sorted, the
first ``k`` of them are its sketch.

1. Documents with the same set form a class; only classes are compared.
2. Inverted lists: a value's list holds the classes that retain it.  Values in one class only are
   dropped.  Two sets with Jaccard similarity J share at least a certain number of retained values:
   for sets of up to J k shingles exactly J n, beyond that J k less 6.5 standard deviations of the
   number of shared values among the smallest k of the union (missed with a chance below 10^-10 for
   a pair).  A class with fewer shared values has no partner.  The others keep their rarest values,
   as many as a pair with that overlap can't both avoid.
3. The classes of a list belong to the group of its smallest class.  A group is cut into blocks, and
   every two blocks meet in one task, so a large group is spread over many.
4. There the overlap of two sketches estimates the similarity; pairs that pass are confirmed on the full
   sets, made again from the texts.  A task gives a spanning forest of the links it confirms, never all
   pairs.
5. Components over these links and the classes.

No list, group or number of partners is capped.

Defined cases: texts without a word have no set and no link; a text of fewer than five words is one
shingle; rows with the same id are one document for links, each with its own count; rows with a null
id are compared with nothing, have a null component and are not kept (``kept`` false); an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import FEW_ROWS, discard, free_name, id_and_text, id_bitmap, id_slot, in_bitmap, map_arrow, stored
from rankfold.llm.components import components

K = 256
DEVIATIONS = 6.5
#: Rows of a block at least and at most, and blocks of a group up to the largest block.
BLOCK, LARGEST_BLOCK, BLOCKS = 256, 4096, 32
#: Sets that a task remembers to have sketched, so that copies in it are sketched once.
SEEN = 500_000


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the windows of ``width`` words; A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and white space are ASCII's
    if not words:
        return np.zeros(0, dtype=np.int64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    key = np.full(n, len(words) if len(words) < width else width, dtype=np.uint64)
    for i in range(min(width, len(words))):  # products and sums wrap around
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i:i + n]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        key = (key ^ (key >> np.uint64(shift))) * np.uint64(factor)
    return np.unique((key ^ (key >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def class_of(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) >> 1


def least_size(threshold: float) -> float:
    """A smaller set is near to itself only: n / (n + 1) stays below the threshold."""
    return threshold / (1 - threshold) - 1e-9


def sketches(docs: DataFrame, k: int, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, cls, sketch (null where no other set can be near, a copy was sketched in this task, or doc_id is null)."""
    least = least_size(threshold)

    def make():
        seen: set[int] = set()

        def step(cols):
            out = {n: [] for n in ("n_shingles", "cls", "sketch")}
            for known, value in zip(cols["doc_id"].is_valid().to_pylist(), cols["text"]):
                values = shingles(value.as_py())
                cls = class_of(values) if len(values) else None
                new = known and cls is not None and cls not in seen and len(values) >= least
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                out["n_shingles"].append(len(values))
                out["cls"].append(cls)
                out["sketch"].append(values[:k] if new else None)
            yield out | {"doc_id": cols["doc_id"]}

        return step

    return map_arrow(id_and_text(docs, id_col, text_col), make, "doc_id bigint, n_shingles bigint, cls bigint, sketch array<bigint>", rows=FEW_ROWS)


def least_overlap(n: Column, k: int, threshold: float) -> Column:
    """Retained values that a set of ``n`` shares with any near set."""
    exact = F.ceil(n * threshold - 1e-9)
    spread = F.sqrt(F.greatest(F.lit(0.0), 1 - F.lit(threshold * k) / n) * (k * threshold * (1 - threshold)))
    return F.when(n <= threshold * k, exact).otherwise(
        F.greatest(F.lit(1), F.least(exact, F.floor(threshold * k - DEVIATIONS * spread)))).cast("int")


def least_overlaps(n: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """The same in numpy."""
    exact = np.ceil(n * threshold - 1e-9)
    spread = np.sqrt(np.maximum(0.0, 1 - threshold * k / n) * (k * threshold * (1 - threshold)))
    return np.where(n <= threshold * k, exact, np.maximum(1, np.minimum(exact, np.floor(threshold * k - DEVIATIONS * spread))))


def overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of 0/1 matrices over values found on both sides."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for side in (left, right):
        flat, owner = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(shared, flat)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(0, len(shared) - 1))] == flat) if len(shared) else np.zeros(len(flat), bool)
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], owner[order]))
    for a in range(0, len(shared), columns):
        both = []
        for (at, owner), side in zip(sides, (left, right)):
            lo, hi = np.searchsorted(at, (a, a + columns))
            m = np.zeros((len(side), min(columns, len(shared) - a)), dtype=np.float32)
            m[owner[lo:hi], at[lo:hi] - a] = 1
            both.append(m)
        out += both[0] @ both[1].T
    return out.astype(np.int64)


def forest(n: int, links: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of ``links`` (pairs of positions below n), each tree a star around its smallest."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in links:
        x, y = find(int(x)), find(int(y))
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in range(n) if find(x) != x]


def near_links(sets: list[np.ndarray], block: np.ndarray, k: int, threshold_percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between the two blocks (within it, if there is one)."""
    first = block == block.min()
    left = np.flatnonzero(first)
    right = left if first.all() else np.flatnonzero(~first)
    size = np.array([len(s) for s in sets])
    t = threshold_percent / 100
    least = least_overlaps(size.astype(float), k, t)
    guess = overlaps([sets[i][:k] for i in left], [sets[j][:k] for j in right])
    near = guess >= np.minimum(least[left][:, None], least[right][None, :])
    near &= left[:, None] < right[None, :] if first.all() else True
    a, b = np.nonzero(near)
    rows, cols = np.unique(a), np.unique(b)
    if not len(rows):
        return []
    exact = np.zeros(near.shape, dtype=np.int64)
    exact[np.ix_(rows, cols)] = overlaps([sets[left[i]] for i in rows], [sets[right[j]] for j in cols])
    both = exact[a, b]
    sure = 100 * both >= threshold_percent * (size[left[a]] + size[right[b]] - both)
    return forest(len(sets), np.stack([left[a[sure]], right[b[sure]]], 1))


def near_duplicates(docs: DataFrame, threshold_percent: int = 85, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: components of texts whose similarity is ``threshold_percent`` or more."""
    t = threshold_percent / 100
    read = id_and_text(docs, id_col, text_col)
    scan = stored(sketches(read, k, t), "sketches")
    known = scan.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")), "classes")

    # inverted lists; one exchange by value serves the removal of copies and the count
    lists = scan.where("sketch IS NOT NULL AND doc_id IS NOT NULL").select("cls", F.explode("sketch").alias("value"))
    lists = lists.repartition("value").dropDuplicates(["value", "cls"])
    shared = lists.withColumn("df", F.count("*").over(Window.partitionBy("value"))).where("df > 1")
    own = shared.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held")).join(classes, "cls")
    need = least_overlap(F.col("n"), k, t)
    kept = own.where(F.size("held") >= need).select("cls", "rep", F.explode(F.slice("held", F.lit(1), F.size("held") - need + 1)).alias("h"))
    prefix = stored(kept.select("cls", "rep", F.col("h.value").alias("value")), "prefixes")

    # groups around the smallest class of a list, cut into blocks
    leaders = prefix.groupBy("value").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("value", "leader")
    members = stored(prefix.join(leaders, "value").select("leader", "cls", "rep").distinct(), "members")
    blocks = members.groupBy("leader").agg(F.count("*").alias("g")).select("leader", F.ceil(
        F.col("g") / F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.ceil(F.col("g") / BLOCKS)))).cast("int").alias("nb"))
    dealt = members.join(blocks, "leader").withColumn("i", F.pmod(F.xxhash64("cls"), "nb").cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    meetings = dealt.select("leader", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("block"), "cls", "rep")

    # texts stay where they are: a bitmap of fixed size tells most that aren't wanted, the join the rest
    wanted = members.select("cls", F.col("rep").alias("doc_id")).distinct()
    bitmap = id_bitmap(wanted)

    def make():
        def step(cols):
            out = {"doc_id": [], "cls": [], "values": []}
            ids = cols["doc_id"].to_pylist()
            for at in np.flatnonzero(in_bitmap(bitmap.value, cols["slot"])):
                values = shingles(cols["text"][at].as_py())
                if len(values) >= least:
                    out["doc_id"].append(ids[at])
                    out["cls"].append(class_of(values))
                    out["values"].append(values.tobytes())
            yield out

        return step

    least = least_size(t)
    sets = map_arrow(read.where("doc_id IS NOT NULL").withColumn("slot", id_slot()), make, "doc_id bigint, cls bigint, values binary", rows=FEW_ROWS)
    # partitioned by class, as the meetings are joined; the join by class needs the id as well, which may have other texts
    sets = sets.join(wanted.withColumnRenamed("doc_id", "rep"), "cls").where("doc_id = rep").select("cls", "values").dropDuplicates(["cls"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(found: pa.Table) -> pa.Table:
        reps = found["rep"].to_numpy()
        values = [np.frombuffer(v.as_py(), dtype=np.int64) for v in found["values"]]
        order = np.argsort(reps, kind="stable")
        tree = near_links([values[i] for i in order], found["block"].to_numpy()[order], k, threshold_percent)
        reps = reps[order].tolist()
        return pa.table({"a": [reps[x] for x, _ in tree], "b": [reps[y] for _, y in tree]}, schema=schema)

    links = meetings.join(sets, "cls").groupBy("leader", "lo", "hi").applyInArrow(meet, "a bigint, b bigint")
    # an id that has several rows binds their classes together
    twice = known.select("doc_id", "cls").join(classes, "cls").groupBy("doc_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("b"), F.countDistinct("rep").alias("m"), F.collect_set("rep").alias("reps"))
    bound = twice.where("m > 1").select("a", F.explode("reps").alias("b"))
    found = stored(links.union(bound), "near")
    discard(members, prefix)
    labels = components(found).select(F.col("id").alias("rep"), F.col("component_id").alias("label"))

    out = scan.select("doc_id", "n_shingles", "cls").join(classes.select("cls", "rep"), "cls", "left").join(labels, "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, threshold_percent: int = 80, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of ``docs``, with all columns; the one with the smallest id stays.

    Rows that repeat id and text are one document.  Rows with a null id are compared with nothing but
    their own repetitions and stay.
    """
    name = free_name(docs, "_gone")
    near = near_duplicates(docs, threshold_percent, k, id_col, text_col)
    gone = near.where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti").dropDuplicates([id_col, text_col])
