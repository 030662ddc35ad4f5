"""Operator 5, repeated passages by a sparse suffix array.

A passage of ``min_words`` words or more is repeated if it stands, word for word, at two places of the
corpus.  Of its places the first (by id, then position) is kept.

1. In every window of ``min_words`` words the minimiser, its ``gram``-word sequence with the smallest
   hash (the first of equal ones), is retained.  It is chosen by content, so equal windows retain the
   same suffix at the same distance from their start; about one word in twenty keeps its suffix.
2. The retained suffixes are sorted by range over the whole corpus, by (their first ``gram`` words, text,
   position), and neighbours are compared.  A suffix whose neighbours begin otherwise is unique and
   dropped.  The range partitioning cuts through suffixes that many texts share; one at the edge of a
   partition, whose neighbour is in the next, stays.
3. What is left is extended to the left and right: every window of which such a suffix is the minimiser
   is looked up by its hash (64 bits) among all windows so found, with its first place.  Minima and
   counts only are gathered, so a passage in a third of all texts is no hot group.
4. Windows found twice or more are joined to spans.

Texts that agree word for word form a class, of which one text is searched; each other one of
``min_words`` words or more is one span, which names that text as its first place.

Defined cases: a null, empty or short text has no span; rows with the same id and the same words are one
document; rows with a null id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import FEW_ROWS, WORD_PATTERN, free_name, id_and_text, id_bitmap, id_slot, in_bitmap, map_arrow, slices, stored

MIN_WORDS, GRAM = 50, 8
SEEN = 500_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(WORD_PATTERN)
SPANS = "doc_id bigint, start bigint, end bigint, removed boolean, first_doc_id bigint"


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(0, n - 1), base, dtype=np.uint64))])[:n]


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` words (arithmetic wraps around)."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(ids * _powers(_BASE, len(ids)))])
    key = (sums[width:] - sums[:-width]) * _powers(_INVERSE, n)
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def minimisers(ids: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``min_words`` words the position of its minimiser, and the hashes of all grams."""
    grams = window_hashes(ids, gram)
    width = min_words - gram + 1
    if len(grams) < width:
        return np.zeros(0, dtype=np.int64), grams
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
    return at + np.arange(len(at)), grams


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def suffix_rows(docs: DataFrame, min_words: int, gram: int) -> DataFrame:
    """doc_id, n_words, cls and, unless this task has had the class before, the retained suffixes."""

    def make():
        seen: set[int] = set()

        def step(cols):
            out = {n: [] for n in ("n_words", "cls", "keys", "positions")}
            for value in cols["text"]:
                ids = word_hashes(value.as_py())
                cls = xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1
                keys = positions = None
                if len(ids) >= min_words and cls not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(cls)
                    at, grams = minimisers(ids, min_words, gram)
                    positions = np.unique(at)
                    keys = _signed(grams[positions])
                for n, v in zip(out, (len(ids), cls, keys, positions)):
                    out[n].append(v)
            yield out | {"doc_id": cols["doc_id"]}

        return step

    return map_arrow(docs, make, "doc_id bigint, n_words bigint, cls bigint, keys array<bigint>, positions array<bigint>", rows=FEW_ROWS)


def shared_suffixes(suffixes: DataFrame) -> DataFrame:
    """(cls, pos) of those (key, cls, pos) rows whose sorted neighbours have the same key, or aren't known."""
    spark = suffixes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes.repartitionByRange(parts, "key", "cls", "pos").sortWithinPartitions("key", "cls", "pos")

    def make():
        held: dict = {}

        def step(cols):
            key, cls, pos = (cols[n].to_numpy(zero_copy_only=False) for n in ("key", "cls", "pos"))
            if not len(key):
                return
            same = key[1:] == key[:-1]
            left = np.append(not held or held["key"] == key[0], same)
            right = np.append(same, True)  # the last may go on in the next batch or partition
            near = left | right
            held["key"] = key[-1]
            yield {"cls": cls[near], "pos": pos[near]}

        return step

    return map_arrow(rows, make, "cls bigint, pos bigint")


def windows_of(docs: DataFrame, wanted: DataFrame, min_words: int, gram: int) -> DataFrame:
    """(h, rep, cls, pos, again) of the windows whose minimiser is among ``wanted`` (cls, doc_id, positions).

    One row for each text and hash, with its first position and the others, so that a text which says
    the same words thousands of times makes no hot group.
    """

    def make():
        def step(cols):
            for doc_id, cls, value, positions in zip(cols["doc_id"].to_pylist(), cols["cls"].to_pylist(), cols["text"], cols["positions"]):
                ids = word_hashes(value.as_py())
                if xxhash.xxh3_64_intdigest(ids.tobytes()) >> 1 != cls:
                    continue  # another text with the same id
                at, _ = minimisers(ids, min_words, gram)
                pos = np.flatnonzero(np.isin(at, positions.values.to_numpy(zero_copy_only=False)))
                h, first, which = np.unique(window_hashes(ids, min_words)[pos], return_index=True, return_inverse=True)
                again: dict[int, list[int]] = {}
                if len(h) < len(pos):
                    for i in np.setdiff1d(np.arange(len(pos)), first):
                        again.setdefault(int(which[i]), []).append(int(pos[i]))
                full = np.ones(len(h), dtype=np.int64)
                yield {"h": _signed(h), "rep": full * doc_id, "cls": full * cls, "pos": pos[first], "again": [again.get(i) for i in range(len(h))]}

        return step

    bitmap = id_bitmap(wanted)

    def sieve(batches):
        for whole in batches:
            for batch in slices(whole, FEW_ROWS):
                near = in_bitmap(bitmap.value, batch.column(2))
                yield batch.filter(pa.array(near)).select([0, 1])

    # texts without a suffix that is left mostly aren't shuffled to the join
    texts = docs.withColumn("slot", id_slot()).mapInArrow(sieve, "doc_id bigint, text string")
    return map_arrow(texts.join(wanted, "doc_id"), make, "h bigint, rep bigint, cls bigint, pos bigint, again array<bigint>")


def runs(covered: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span of repeated words: doc_id, start, end (words, end exclusive), removed, first_doc_id.

    ``removed`` spans have stood before, at ``first_doc_id`` for their first window; the others are the
    first places of what is repeated later.  Spans with the same ``removed`` don't touch.
    """
    read = id_and_text(docs, id_col, text_col).where("doc_id IS NOT NULL")
    scan = stored(suffix_rows(read, min_words, gram), "suffixes")
    texts = scan.where(F.col("n_words") >= min_words)
    classes = stored(texts.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n_words").alias("n"),
                                              (F.min("doc_id") < F.max("doc_id")).alias("copied")), "classes")

    suffixes = texts.where("keys IS NOT NULL").select("cls", F.explode(F.arrays_zip("keys", "positions")).alias("s"))
    found = shared_suffixes(suffixes.select(F.col("s.keys").alias("key"), "cls", F.col("s.positions").alias("pos")))
    wanted = stored(found.groupBy("cls").agg(F.collect_set("pos").alias("positions")).join(classes, "cls").select(
        "cls", F.col("rep").alias("doc_id"), "positions"), "wanted")
    # repeated rows hold the same window; it is one place
    windows = stored(windows_of(read, wanted, min_words, gram), "windows")
    places = windows.groupBy("h").agg(F.min(F.struct("rep", "cls", "pos")).alias("lo"), F.max(F.struct("rep", "cls", "pos")).alias("hi"),
                                       F.bool_or(F.col("again").isNotNull()).alias("again"))
    twice = places.where("lo <> hi OR again").select("h", "lo")
    hits = windows.join(twice, "h").select("cls", F.struct(
        "pos", (F.struct("rep", "cls", "pos") != F.col("lo")).alias("later"), F.col("lo.rep").alias("first"), "again").alias("w"))
    marked = classes.join(hits.groupBy("cls").agg(F.sort_array(F.collect_list("w")).alias("ws")), "cls", "left").where("ws IS NOT NULL OR copied")
    marked = marked.select("rep", "n", "copied", F.col("ws.pos").alias("pos"), F.col("ws.later").cast("array<int>").alias("later"), F.col("ws.first").alias("first"), F.col("ws.again").alias("again"))

    def make():
        def step(cols):
            out = {n: [] for n in ("doc_id", "start", "end", "removed", "first_doc_id")}
            for rep, n, copied, pos, later, first, again in zip(*(cols[c].to_pylist() for c in ("rep", "n", "copied", "pos", "later", "first", "again"))):
                others = [(p, 1, f) for f, more in zip(first or (), again or ()) for p in more or ()]
                pos, later, first = (np.array((x or []) + [o[k] for o in others], dtype=np.int64) for k, x in enumerate((pos, later, first)))
                cover = np.zeros((2, n + 1), dtype=np.int64)
                for kind in (0, 1):
                    np.add.at(cover[kind], pos[later == kind], 1)
                    np.add.at(cover[kind], np.minimum(n, pos[later == kind] + min_words), -1)
                seen, gone = np.cumsum(cover, axis=1)[:, :n] > 0
                seen = (seen | bool(copied)) & ~gone
                source = dict(zip(pos[later == 1].tolist(), first[later == 1].tolist()))
                for kind, covered in ((False, seen), (True, gone)):
                    for a, b in runs(covered):
                        for name, v in zip(out, (rep, a, b, kind, source.get(a, rep) if kind else rep)):
                            out[name].append(v)
            yield out

        return step

    spans = map_arrow(marked, make, SPANS, rows=FEW_ROWS)
    copies = texts.select("doc_id", "cls").distinct().join(classes.where("copied"), "cls").where("doc_id <> rep").select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(True).alias("removed"), F.col("rep").alias("first_doc_id"))
    return spans.unionByName(copies)


def cut_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without these spans of words; the white space before a span goes with it."""
    if not text or not spans:
        return text
    ends = [m.end() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for a, b in sorted(spans):
        cut = ends[a - 1] if a else 0
        parts.append(text[at:max(at, cut)])
        at = max(at, ends[min(b, len(ends)) - 1])
    return "".join(parts) + text[at:]


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, their texts without removed spans; the rows all stay.

    Rows with the same id are cut alike where their words agree (as one document); where an id has
    several different texts, spans can't be told apart and the id's texts are left whole.
    """
    key, found_col = free_name(docs, "_key"), free_name(docs, "_spans")
    spans = repeated_passages(docs, min_words, gram, id_col, text_col).where("removed")
    lists = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(found_col))
    texts = id_and_text(docs, id_col, text_col).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    lists = lists.join(texts.where("a <> b").select("doc_id"), "doc_id", "left_anti")
    joined = docs.join(lists.withColumnRenamed("doc_id", key), F.col(f"`{id_col}`").cast("long") == F.col(key), "left")

    @F.udf("string")
    def cut(text, found):  # is called for rows without spans too
        return cut_words(text, [(s["start"], s["end"]) for s in found or ()])

    new = cut(F.col(f"`{text_col}`").cast("string"), found_col)
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
