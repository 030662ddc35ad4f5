"""Operator 3, packing by non-negative least squares.

1. Every text becomes token ids plus a closing id; a row of ids is cut into full windows and a rest.
2. The histogram of piece lengths (at most ``window`` numbers) goes to the driver.  All combinations
   of at most ``depth`` lengths that fill a window exactly are enumerated, and non-negative least
   squares finds how often to repeat each so that the histogram is met.  The repeats are rounded; what
   is left is packed greedily, again on the histogram only.
3. The plan is a list of (length, first rank, repeats, sequence, offset).  Pieces of equal length are
   ranked by Spark in salted buckets, so that a length which a third of all pieces share is no hot
   task, and the rank looks up its place.

Defined cases: a null text counts as empty, and an empty text is the closing id alone.  Rows with the
same id are packed each for itself; a null id stays null.  Ties among equal lengths go by bucket, id,
start and checksum, rows that agree in all of them being interchangeable.  An empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankfold.llm.common import id_and_text, map_arrow, remembered, stored

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Where a cut at every blank would be wrong.
ODD_SPACE = re.compile(r"\s\s|^\s|\s\Z")
#: White space other than blank and line feed.
RARE_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: How a byte-level tokenizer cuts texts into units.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of the texts that are encoded at a time.
BATCH_CHARS = 12_000_000
#: Parts whose ids are looked up at a time.
CHUNK = 100_000


def odd_space(text: str) -> bool:
    """Whether white space stands next to white space or at an end; other texts may be cut at every blank."""
    if RARE_SPACE.search(text):
        return ODD_SPACE.search(text) is not None
    return "  " in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes of every token with its id, if the tokenizer (a ``tokenizers`` JSON) is plain byte-level BPE whose merges come
    in the order of their ids; such a one merges by the least id.  Otherwise None."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk", "byte_fallback")):
        return None
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])):
        return None
    letters, special = _byte_characters(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    made = set(made)
    single = [t for t, i in ranks.items() if i not in made]
    return ranks if len(single) == 256 and all(len(t) == 1 for t in single) else None


class TextEncoder:
    """Ids of whole texts, as ``tokenizers`` gives them without special tokens, each with a closing id.

    A plain byte-level tokenizer (:func:`byte_level_ranks`) starts a new unit at every single blank between two
    visible characters, so a text may be cut there, and the ids of the parts follow one another.  The different parts
    of a batch of texts are encoded together, once, by ``tiktoken`` with the same tokens, and looked up from there.
    The first part of a text, which has no blank before it, and texts with other blanks are encoded each by itself.
    Any other tokenizer encodes whole texts itself.  Strings of special tokens are ordinary text.  Nothing is
    remembered between batches.
    """

    def __init__(self, blob: str, end_id: int = 0):
        self.end = np.array([end_id], dtype="<u4")
        ranks = byte_level_ranks(json.loads(blob))
        if ranks is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(blob)
            whole.encode_special_tokens = True
            self._ids = lambda text: np.array(whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            self._cut = lambda text: False
            return
        import tiktoken

        core = tiktoken.Encoding("packing", pat_str=UNITS, mergeable_ranks=ranks, special_tokens={})
        self._ids = lambda text: core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        self._cut = lambda text: not odd_space(text)
        self.id_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.id_bytes[i] = len(token)

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts with a blank before each, one after the other, and the end of each."""
        if not len(parts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        ids = self._ids(" " + " ".join(parts.to_pylist()))
        ends = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        return ids, np.searchsorted(np.cumsum(self.id_bytes[ids]), ends, side="left") + 1

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text with the closing id."""
        cut = [self._cut(t) for t in texts]
        lists = pc.split_pattern(pa.array([t if c else "" for t, c in zip(texts, cut)], pa.string()), " ")
        offsets, flat = lists.offsets.to_numpy(), lists.flatten()
        rest = np.ones(len(flat), dtype=bool)
        rest[offsets[:-1]] = False  # every text has a first part, the empty one too
        heads = [self._ids(t.split(" ", 1)[0] if c else t) for t, c in zip(texts, cut)]
        coded = flat.filter(pa.array(rest)).dictionary_encode()
        ids, ends = self._parts(coded.dictionary)
        starts = np.concatenate([[0], ends]).astype(np.int32)
        sizes = np.diff(starts)
        part = coded.indices.to_numpy(zero_copy_only=False)
        at = (offsets - np.arange(len(texts) + 1)).tolist()  # of each text's parts but the first
        first = 0
        while first < len(texts):  # some CHUNK parts at a time, so that arrays stay small
            last = max(first + 1, bisect.bisect_right(at, at[first] + CHUNK) - 1)
            some = part[at[first]:at[last]]
            size = sizes[some]
            after = np.cumsum(size, dtype=np.int32)
            got = ids[np.repeat(starts[some] - (after - size), size) + np.arange(after[-1] if len(after) else 0, dtype=np.int32)]
            begin = 0
            for k in range(first, last):
                n = at[k + 1] - at[first]
                end = int(after[n - 1]) if n else 0
                yield np.concatenate([heads[k], got[begin:end], self.end])
                begin = end
            first = last


def token_pieces(docs: DataFrame, tokenizer_json: str, window: int = 1024, end_id: int = 0, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids of every text; with ``keep_ids`` the ids too.

    Texts are encoded in batches of some BATCH_CHARS characters, one text at least.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, of fixed size

    def make():
        encoder = remembered(f"ids-{zlib.crc32(blob.value.encode())}-{end_id}", lambda: TextEncoder(blob.value, end_id))

        def pieces(doc_ids, texts):
            out = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                for a in range(0, len(ids), window):
                    part = ids[a:a + window]
                    for n, v in zip(out, (doc_id, a, len(part), zlib.crc32(part), len(ids), part.astype(np.int32) if keep_ids else None)):
                        out[n].append(v)
            return out

        def step(cols):
            held, doc_ids, texts = 0, [], []
            for doc_id, text in zip(cols["doc_id"].to_pylist(), cols["text"]):
                texts.append(text.as_py() or "")
                doc_ids.append(doc_id)
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    yield pieces(doc_ids, texts)
                    held, doc_ids, texts = 0, [], []
            if texts:
                yield pieces(doc_ids, texts)

        return step

    return map_arrow(id_and_text(docs, id_col, text_col), make, PIECES + (", ids array<int>" if keep_ids else ""), remembers=True)


def combinations(window: int, depth: int) -> np.ndarray:
    """All falling rows of ``depth`` lengths (0: unused) whose sum is ``window``, with depth up to 3."""
    rows = [[window, 0, 0]]
    if depth >= 2:
        a = np.arange((window + 1) // 2, window)
        rows += np.stack([a, window - a, 0 * a], 1).tolist()
    if depth >= 3:
        for a in range((window + 2) // 3, window - 1):
            b = np.arange((window - a + 1) // 2, min(a, window - a - 1) + 1)
            rows += np.stack([0 * b + a, b, window - a - b], 1).tolist()
    return np.array(rows, dtype=np.int64)


def repeat_counts(hist: np.ndarray, combos: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |A x - hist| with x >= 0, where column j of A counts the lengths of combination j.

    Projected gradient steps with momentum, scaled by the row sums of AᵀA, which bound its curvature
    because no entry is negative.
    """
    n = len(hist)
    used = (combos > 0).astype(float)

    def apply(x):
        got = np.bincount(combos.ravel(), weights=np.repeat(x, combos.shape[1]), minlength=n)
        got[0] = 0
        return got

    def transpose(r):
        return (r[combos] * used).sum(1)

    step = 1.0 / transpose(apply(np.ones(len(combos))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * transpose(apply(y) - hist))
        if ((y - new) * (new - x)).sum() > 0:
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def plan_windows(hist: np.ndarray, window: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) such that the lengths times repeats are exactly the histogram."""
    left, plan = hist.astype(np.int64).copy(), []
    left[0] = 0
    combos = combinations(window, depth)
    combos = combos[(left[combos] > 0).sum(1) == (combos > 0).sum(1)]  # only of lengths that occur
    if len(combos):
        x = repeat_counts(left.astype(float), combos)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            lengths, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
            n = min(int(np.rint(x[j])), int((left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                plan.append((tuple(int(v) for v in combos[j] if v), n))
    while left.any():  # the rest: the longest first, then always the longest that still fits
        lengths, space, avail = [], window, left.copy()
        while space > 0 and (fit := np.flatnonzero(avail[:space + 1])).size:
            lengths.append(int(fit[-1]))
            avail[fit[-1]] -= 1
            space -= int(fit[-1])
        kinds, times = np.unique(lengths, return_counts=True)
        n = int((left[kinds] // times).min())
        left[kinds] -= n * times
        plan.append((tuple(lengths), n))
    return plan


def places(plan: list[tuple[tuple[int, ...], int]], window: int) -> tuple[np.ndarray, ...]:
    """Sorted (length * 2^40 + first rank) and, for each, first sequence and offset."""
    rank, sequence, rows = np.zeros(window + 1, dtype=np.int64), 0, []
    for lengths, n in plan:
        offset = 0
        for v in lengths:
            rows.append((v << 40 | int(rank[v]), sequence, offset))
            rank[v] += n
            offset += v
        sequence += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ([], [], [])))


def pack(pieces: DataFrame, window: int = 1024, depth: int = 3, buckets: int = 256) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``window``.

    ``pieces`` is read three times; hand over something stored.
    """
    spark = pieces.sparkSession
    keys = [c for c in ("doc_id", "start", "ids_crc32") if c in pieces.columns]
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = salted.groupBy("length", "_bucket").count()
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `window` rows
        hist[r["length"]] = r["n"]
    where = spark.sparkContext.broadcast(places(plan_windows(hist, window, depth), window))

    before = F.sum("count").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = (salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)) - 1)
              .join(bases, ["length", "_bucket"])
              .withColumn("_rank", F.col("_rank") + F.col("_base")).select(*pieces.columns, "_rank"))
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    names = pieces.columns

    def make():
        key, sequence, offset = where.value

        def step(cols):
            length = cols["length"].to_numpy(zero_copy_only=False)
            rank = cols["_rank"].to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, length << 40 | rank, side="right") - 1
            yield {n: cols[n] for n in names} | {"sequence_id": sequence[at] + rank - (key[at] & (1 << 40) - 1), "offset": offset[at]}

        return step

    return map_arrow(ranked, make, out_schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, window: int = 1024, depth: int = 3, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts to packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    pieces = stored(token_pieces(docs, tokenizer_json, window, keep_ids=keep_ids, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, window, depth)


def padding(packed: DataFrame, window: int = 1024) -> DataFrame:
    """One row: sequences, tokens and padding; a sequence whose fill is a power of two needs none."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    whole = F.expr("bit_count(fill) = 1")
    return fill.agg(F.count("*").alias("sequences"), F.sum("fill").alias("tokens"),
                    F.sum(F.when(whole, 0).otherwise(window - F.col("fill"))).alias("padding"))
