"""Merkle manifest of a table of documents: leaves, levels of 16 per source, one root, and proofs.

Building: leaves are numbered inside their source (ranges, no window over a hot source), and every level groups
runs of 16 consecutive nodes of the level below, until each source has one node left, its subroot.  The subroots,
in the order of their sources, are the leaves of one more tree, whose last node is the root.  The levels are stored
as node rows that name their parent: (node, up, ord, up_salts, salt, top, children).  Digests are held as 32 bytes; what
is hashed, and what is given out, is their hex text.

Climbing: a recursive query (``WITH RECURSIVE``) ascends from the leaves to the root.  The leaves of one block of two
levels (256 at most) share all siblings above it, so they climb in one row that holds the different hashes folded from
them; every step joins the rows with the parents, appends the parent's other children to the siblings and folds each
hash.  Many rows meet few nodes near the root: a node stands there once for every 32 rows below it, and a row takes
the copy of its own hash.

Defined cases: a null in any column enters a leaf as ``-``; a null source is a source of its own, before all others;
rows with a null id come before those with ids, rows that repeat an id are ordered by their leaf, and rows that are
equal in all columns are leaves of their own; an empty table gives no rows and a null root.  Other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import stored
from rankfold.llm.ranks import placed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 16
_BITS = 4
#: Climbing rows that meet one copy of a node.
SHARE = 32


def leaf_hash(values: dict[str, Column]) -> Column:
    """Hash (32 bytes) of the values in the order of ``FIELDS``: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(framed(values[f]) for f in FIELDS)), 256))


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, _hex), "")


def _node_hash(children: Column) -> Column:
    return F.unhex(F.sha2(_joined(children), 256))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def tamper_every_fifth(docs: DataFrame) -> Column:
    """Where 5 divides crc32 of the decimal id: the text with A-Z lower-cased; other texts as they are."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))


@dataclass
class Manifest:
    """``blocks``: the leaves by blocks of 256 (members, digests of the runs, hashes folded up to the block);
    ``starts``: the blocks' places below their parents, from where they climb; ``nodes``: the parent-linked rows above
    them; ``root``: hex digest, None for an empty table."""

    blocks: DataFrame
    starts: DataFrame
    nodes: DataFrame
    root: str | None


_BLOCK = "node string, members array<struct<doc_id:bigint,leaf:binary,fold:int>>, digests array<binary>, folds array<binary>"
_NODE = "node string, top boolean, children array<binary>, folds array<binary>, up string, ord int, up_salts int, salt int"


def _by_ord(run: str) -> Column:
    return F.array_sort(run, lambda a, b: a["ord"] - b["ord"])


def _ord() -> Column:
    return F.col("idx").bitwiseAND(F.lit(FAN - 1)).cast("int").alias("ord")


def _name(depth: int) -> Column:
    return F.concat_ws("/", F.lit(str(depth)), F.col("tree").cast("string"), F.col("idx").cast("string"))


def _fewer(count: str) -> Column:
    return F.floor((F.col(count) + FAN - 1) / FAN).cast("long")


def _copies() -> Column:
    return F.ceil(F.col("w") / SHARE).cast("int")


def _level(nodes: DataFrame, depth: int) -> DataFrame:
    """One row per run of 16 nodes of a tree, with the run's nodes in ``kids``."""
    kid = F.struct(_ord(), "node", "digest", "top", "children", "folds", "copies")
    up = nodes.groupBy("tree", F.shiftright("idx", _BITS).alias("idx"), "left").agg(
        F.collect_list(kid).alias("kids"), F.sum("w").alias("w"))  # 16 at most
    return stored(up.select("tree", "idx", _fewer("left").alias("left"), _by_ord("kids").alias("kids"), "w"), f"level{depth}")


def _parents(level: DataFrame, depth: int) -> DataFrame:
    """The level's own rows, shaped as nodes of the next step."""
    children = F.transform("kids", lambda k: k["digest"])
    return level.select(
        _name(depth).alias("node"), "tree", "idx", "left", _node_hash(children).alias("digest"), "w", (F.col("tree") < 0).alias("top"),
        children.alias("children"), F.lit(None).cast("array<binary>").alias("folds"), _copies().alias("copies"))


def _linked(level: DataFrame, depth: int) -> DataFrame:
    """The kids of a level, each with its parent, its place in the run and the number of the parent's copies."""
    return level.select(F.explode("kids").alias("k"), _name(depth).alias("up"), _copies().alias("up_salts")) \
        .select("k.node", "k.digest", "k.top", "k.children", "k.folds", "k.copies", "up", F.col("k.ord").alias("ord"), "up_salts")


def _numbered(docs: DataFrame, tampered: Column | None) -> tuple[DataFrame, int]:
    """Leaves with the number of their source and their own in it (tree, idx, size), and the number of sources."""
    values = {f: F.col(f) for f in FIELDS}
    leaf = leaf_hash(values)
    other = F.lit(None).cast("binary") if tampered is None else leaf_hash({**values, "text": tampered})
    leaves = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"),
                                other.alias("other")).select("doc_id", "source", "leaf", F.nullif("other", "leaf").alias("changed")), "leaves")
    rows, offsets = placed(leaves, ["source"], ["doc_id", "leaf"], "ranked_leaves")
    offsets = stored(offsets, "leaf_offsets")
    # the number of a source in the order of sources; one row per source
    sources, source_offsets = placed(offsets.select("source").distinct(), [], ["source"], "sources")
    trees = sources.join(F.broadcast(source_offsets), "_range").select(F.col("source").alias("s2"), (F.col("_at") + F.col("_offset")).alias("tree"))
    offsets = offsets.select(F.col("source").alias("s1"), F.col("_range").alias("r1"), "_offset", F.col("_size").alias("size"))
    offsets = offsets.join(trees, F.col("s1").eqNullSafe(F.col("s2")))
    ranked = rows.join(offsets, rows["source"].eqNullSafe(offsets["s1"]) & (rows["_range"] == offsets["r1"]))
    return ranked.select("tree", (F.col("_at") + F.col("_offset")).alias("idx"), "size", "doc_id", "leaf", "changed"), sources.count()


def build(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (columns ``FIELDS``); ``tampered`` is a text to fold in place of each row's own.

    The driver sees the number of levels, of sources and the root.  Every level is written as Parquet, so a lost
    executor costs the level at hand.
    """
    ranked, n_sources = _numbered(docs, tampered)
    blocks = stored(_blocks(ranked), "blocks")
    nodes = blocks.select(
        "node", "tree", "idx", F.ceil(F.col("size") / (FAN * FAN)).cast("long").alias("left"), "digest", F.lit(1).cast("long").alias("w"),
        F.lit(False).alias("top"), F.lit(None).cast("array<binary>").alias("children"), "folds", F.lit(1).alias("copies"))
    blocks = blocks.select("node", "members", "digests", "folds")

    linked, subroots, depth = [], [], 2
    left = nodes.agg(F.max("left")).first()[0] or 0
    if not left:
        none = docs.sparkSession.createDataFrame([], _NODE)
        return Manifest(blocks, none, none, None)
    while left > 0:  # levels below the subroots; a source that has one node left waits for the others
        subroots.append(nodes.where("left = 1"))
        if left > 1:
            depth += 1
            level = _level(nodes.where("left > 1"), depth)
            linked.append(_linked(level, depth))
            nodes = _parents(level, depth)
        left = 0 if left == 1 else -(-left // FAN)
    nodes = functools.reduce(DataFrame.unionByName, subroots)
    left = n_sources
    nodes = nodes.withColumn("idx", F.col("tree")).withColumn("tree", F.lit(-1).cast("long")).withColumn("left", F.lit(left).cast("long"))
    while left > 1:  # the tree over the subroots
        depth += 1
        level = _level(nodes, depth)
        linked.append(_linked(level, depth))
        nodes = _parents(level, depth)
        left = -(-left // FAN)
    last = nodes.select("node", "digest", "top", "children", "folds", "copies", F.lit(None).cast("string").alias("up"),
                        F.lit(None).cast("int").alias("ord"), F.lit(None).cast("int").alias("up_salts"))
    root = last.first()["digest"]
    every = stored(functools.reduce(DataFrame.unionByName, linked, last), "nodes")
    above = every.where(F.col("folds").isNull()).drop("folds", "digest")
    above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    starts = every.where(F.col("folds").isNotNull()).select("node", "folds", "up", "ord", F.pmod(F.xxhash64("node"), "up_salts").cast("int").alias("salt"))
    return Manifest(blocks, starts, stored(above, "copied_nodes"), bytes(root).hex())


def _others(run: Column, at: Column) -> tuple[Column, Column]:
    """Hex text of what stands before and after place ``at`` (from 0) of a run."""
    return _joined(F.slice(run, F.lit(1), at)), _joined(F.slice(run, at + 2, F.lit(FAN)))


def _replaced(run: Column, at: Column, digest: Column) -> Column:
    before, after = _others(run, at)
    return F.unhex(F.sha2(F.concat(before, _hex(digest), after), 256))


def _run_of(leaves: Column, i: Column) -> Column:
    return F.slice(leaves, F.shiftright(i, _BITS) * FAN + 1, F.lit(FAN))


def _place(i: Column) -> Column:
    return i.bitwiseAND(F.lit(FAN - 1))


def _blocks(ranked: DataFrame) -> DataFrame:
    """Leaves by blocks of 256: the digests of the block's runs, its own, and the different hashes folded up to it."""
    member = F.struct(F.col("idx").bitwiseAND(F.lit(FAN * FAN - 1)).cast("int").alias("ord"), "doc_id", "leaf", "changed")
    rows = ranked.groupBy("tree", F.shiftright("idx", 2 * _BITS).alias("idx"), "size").agg(F.collect_list(member).alias("every"))
    rows = rows.withColumn("every", _by_ord("every")).withColumn("leaves", F.transform("every", lambda m: m["leaf"]))
    run_hash = F.transform(F.sequence(F.lit(0), F.shiftright(F.size("leaves") - 1, _BITS)), lambda r: _node_hash(
        F.slice("leaves", r * FAN + 1, F.lit(FAN))))
    # a source of one leaf has no run, one of up to 16 leaves no level above its run
    rows = rows.withColumn("digests", F.when(F.col("size") == 1, F.col("leaves")).otherwise(run_hash))
    low = F.transform("every", lambda m, i: F.when(F.col("size") == 1, F.coalesce(m["changed"], m["leaf"])).otherwise(
        _replaced(_run_of(F.col("leaves"), i), _place(i), F.coalesce(m["changed"], m["leaf"]))))
    rows = rows.withColumn("low", low)
    high = F.transform("low", lambda f, i: F.when(F.col("size") <= FAN, f).otherwise(_replaced(F.col("digests"), F.shiftright(i, _BITS), f)))
    rows = rows.withColumn("high", high).withColumn("folds", F.array_distinct("high"))
    members = F.transform("every", lambda m, i: F.struct(
        m["doc_id"].alias("doc_id"), m["leaf"].alias("leaf"), F.array_position("folds", F.get("high", i)).cast("int").alias("fold")))
    digest = F.when(F.col("size") <= FAN, F.get("digests", F.lit(0))).otherwise(_node_hash(F.col("digests")))
    return rows.select(_name(2).alias("node"), "tree", "idx", "size", digest.alias("digest"), members.alias("members"), "digests", "folds")


_CLIMB = """
WITH RECURSIVE climb (block, folds, above, subroot, up, ord, salt) AS (
  SELECT node, folds, CAST(array() AS ARRAY<BINARY>), CAST(NULL AS BINARY), up, ord, salt FROM {starts}
  UNION ALL
  SELECT c.block,
         transform(c.folds, f -> unhex(sha2(concat(
             array_join(transform(slice(n.children, 1, c.ord), x -> lower(hex(x))), ''), lower(hex(f)),
             array_join(transform(slice(n.children, c.ord + 2, {fan}), x -> lower(hex(x))), '')), 256))),
         concat(c.above, slice(n.children, 1, c.ord), slice(n.children, c.ord + 2, {fan})),
         coalesce(c.subroot, IF(n.top, n.children[c.ord], NULL)),
         n.up, n.ord, CAST(pmod(xxhash64(c.block), n.up_salts) AS INT)
  FROM climb c JOIN {nodes} n ON c.up = n.node AND c.salt = n.salt)
SELECT block, folds, above, subroot FROM climb WHERE up IS NULL LIMIT ALL
"""


def climb(manifest: Manifest) -> DataFrame:
    """Each leaf's proof and the root folded from its tampered leaf.

    (doc_id, leaf, subroot, root, siblings string, folded_root, verified); ``siblings`` is the proof itself, the
    digests of the siblings from the leaf's run up to the root, left to right, 64 hex digits each.  The recursion is
    as deep as the trees are high; it has no limit of rows (LIMIT ALL).
    """
    spark = manifest.starts.sparkSession
    top = spark.sql(_CLIMB, starts=manifest.starts, nodes=manifest.nodes, fan=FAN)
    top = top.select(F.col("block").alias("node"), F.transform("folds", _hex).alias("ends"), _joined(F.col("above")).alias("rest"), "subroot")
    rows = manifest.blocks.drop("folds").join(top, "node").withColumn("leaves", F.transform("members", lambda m: m["leaf"]))
    rows = rows.withColumn("rests", F.transform("digests", lambda d, r: F.concat(*_others(F.col("digests"), r), F.col("rest"))))
    each = rows.select("leaves", "rests", "subroot", "ends", F.posexplode("members").alias("i", "m"))
    own = _others(_run_of(F.col("leaves"), F.col("i")), _place(F.col("i")))
    root, fold = F.lit(manifest.root).cast("string"), F.get("ends", F.col("m.fold") - 1)
    return each.select(
        F.col("m.doc_id").alias("doc_id"), _hex(F.col("m.leaf")).alias("leaf"), F.coalesce(_hex(F.col("subroot")), root).alias("subroot"),
        root.alias("root"), F.concat(*own, F.get("rests", F.shiftright("i", _BITS))).alias("siblings"), fold.alias("folded_root"),
        (fold == root).alias("verified"))
