"""Maximal periodic runs of words in each document, by internal pattern matching.

A batch of texts is one sequence of word numbers, with comparisons that never leave a text.  Prefix doubling gives the
classes of all stretches of 2^k words and with them the suffix array; stretches of one class are an interval of it.
Blocks of 2^k words at every 2^k-th position (the shortest: 2 words at every 4th) ask for their next occurrences in
the neighbouring window, for periods from 2^(k+1) - 1 to 2^(k+2) - 2 (the shortest: 1 to 6): the least position not
below x in the interval, from a wavelet matrix over the suffix array.  A run of period p and 2 p words, 12 at least,
holds such a block and its copy p words on.  A block whose next copy is at most half its length away is periodic
itself: its copies come in arithmetic progressions, one per stretch with that period.  The block's own stretch is
skipped (its differences are multiples of that period), every member of another progression is a candidate.
Candidates are extended to both sides by the classes, from long to short, and of equal stretches the smallest
period stays.

Texts are taken whole, in Arrow batches cut to some BATCH_BYTES of text (one text at least); memory is about 100
bytes a word of a batch.

Defined cases: a null or empty text, or one without words, has no run; a row with a null id is never planted; rows
that repeat an id are worked on one by one; an empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rankfold.llm.common import id_and_text, map_arrow

MIN_LENGTH = 12
BATCH_BYTES = 4 << 20


class Classes:
    """Classes of all stretches of 2^k positions, within texts, and the suffix array.

    ``of[k][i]`` is the first place, in the suffix array, of the suffixes that agree with suffix i in 2^k positions.
    A stretch that would leave its text is of no other stretch's class.
    """

    def __init__(self, ids: np.ndarray, text: np.ndarray, end: np.ndarray):
        n = len(ids)
        self.end = end  # end of the text of each position
        key = text.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        place, size = _places(key[order], np.arange(n))
        rank[order] = place
        self.of = [rank.astype(np.int32)]
        self.tied = [self._tied(order, place, size)]  # (positions, places of the class, its size) of classes above one
        half = 1
        while len(self.tied[-1][0]):
            pos, at, _ = self.tied[-1]
            nxt = pos + half
            inside = nxt < end[pos]
            second = np.where(inside, rank[np.where(inside, nxt, 0)], -1)
            by = np.argsort(at * (n + 1) + second + 1, kind="stable")
            pos, at, second = pos[by], at[by], second[by]
            start = at + np.arange(len(pos)) - _places(at, np.arange(len(pos)))[0]  # place of each row itself
            place, size = _places(at * (n + 1) + second + 1, start)
            rank[pos] = place
            self.of.append(rank.astype(np.int32))
            self.tied.append(self._tied(pos, place, size))
            half *= 2
        self.suffixes = np.empty(n, dtype=np.int64)
        self.suffixes[rank] = np.arange(n)

    @staticmethod
    def _tied(pos, place, size):
        many = size > 1
        return pos[many], place[many], size[many]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes i and j of one text."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            a, b = i + got, j + got
            ok = (a < self.end[i]) & (b < self.end[j])
            same = ok & (self.of[k][np.where(ok, a, 0)] == self.of[k][np.where(ok, b, 0)])
            got[same] += 1 << k
        return got

    def back(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what stands before i and before j (i < j)."""
        got = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.of) - 1, -1, -1):
            a, b = i - got - (1 << k), j - got - (1 << k)
            ok = a >= begin
            same = ok & (self.of[k][np.where(ok, a, 0)] == self.of[k][np.where(ok, b, 0)])
            got[same] += 1 << k
        return got


def _places(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: for each row the ``start`` of the first row with its key, and the number of rows with it."""
    n = len(key)
    if not n:
        return start.astype(np.int64), np.zeros(0, dtype=np.int64)
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    return np.repeat(start[first], size), np.repeat(size, size)


class Wavelet:
    """Wavelet matrix over a sequence of different numbers below its length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, (n - 1).bit_length()) if n else 1
        self.zeros, self.ahead = [], []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            self.ahead.append(np.concatenate([[0], np.cumsum(zero, dtype=np.int32)]))
            self.zeros.append(int(self.ahead[-1][-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of places lo..hi-1 are below x."""
        got = np.where(x >= 1 << self.bits, hi - lo, 0)
        live = x < 1 << self.bits
        for k, (zeros, ahead) in enumerate(zip(self.zeros, self.ahead)):
            one = (x >> (self.bits - 1 - k)) & 1 == 1
            zl, zh = ahead[lo], ahead[hi]
            got += np.where(one & live, zh - zl, 0)
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return got

    def smallest(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of the given rank (from 0) among places lo..hi-1."""
        out = np.zeros(len(lo), dtype=np.int64)
        for k, (zeros, ahead) in enumerate(zip(self.zeros, self.ahead)):
            zl, zh = ahead[lo], ahead[hi]
            low = zh - zl
            one = rank >= low
            out = (out << 1) | one
            rank = np.where(one, rank - low, rank)
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return out

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value not below x among places lo..hi-1, or -1."""
        rank = self.below(lo, hi, x)
        some = rank < hi - lo
        out = np.full(len(lo), -1, dtype=np.int64)
        if some.any():
            out[some] = self.smallest(lo[some], hi[some], rank[some])
        return out


def _queries(classes: Classes, begin: np.ndarray) -> dict[str, np.ndarray]:
    """The blocks whose class has other members: position, interval, block length, least and greatest distance."""
    parts = []
    for k in range(1, len(classes.tied)):
        pos, place, size = classes.tied[k]
        length = 1 << k
        steps = ((4, 1, 6),) if k == 1 else ((length, 2 * length - 1, 4 * length - 2),)
        for step, least, most in steps:
            on = (pos - begin[pos]) % step == 0
            t = pos[on]
            parts.append(np.stack([t, place[on], place[on] + size[on], np.full(len(t), length), np.full(len(t), least), np.full(len(t), most)]))
    q = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), dtype=np.int64)
    return dict(zip(("t", "lo", "hi", "len", "least", "most"), q))


def _candidates(classes: Classes, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block positions, distances) of all occurrences that the blocks find in their windows."""
    q = _queries(classes, begin)
    none = np.zeros(0, dtype=np.int64)
    if not len(q["t"]):
        return none, none
    # the matrix holds only the places that lie in an interval of at least two stretches of two words
    n = len(classes.end)
    tied_pos, tied_place, _ = classes.tied[1]
    used = np.zeros(n + 1, dtype=np.int64)
    used[1:][classes.of[-1][tied_pos]] = 1
    packed = np.cumsum(used)  # places before a place
    here = np.zeros(n + 1, dtype=np.int64)
    here[1:][tied_pos] = 1
    packed_pos = np.cumsum(here)
    position = np.flatnonzero(here[1:])
    matrix = Wavelet(packed_pos[classes.suffixes[used[1:] == 1]])

    def successor(sel, x):
        s = matrix.successor(packed[q["lo"][sel]], packed[q["hi"][sel]], packed_pos[np.minimum(x, n)])
        return np.where(s >= 0, position[np.maximum(s, 0)], -1)

    ts, ds = [], []
    sel = np.arange(len(q["t"]))
    t = q["t"]
    first = successor(sel, t + 1)
    keep = (first >= 0) & (first <= t + q["most"])
    sel, first = sel[keep], first[keep]
    t, length = q["t"][sel], q["len"][sel]
    # 0: the block isn't periodic, or its period is one of the window's own
    period = np.where((2 * (first - t) <= length) & (first - t < q["least"][sel]), first - t, 0)
    own = np.flatnonzero(period)
    x = np.maximum(first, t + q["least"][sel])
    if len(own):
        a, d = t[own], period[own]
        stop = a + d + classes.ahead(a, a + d)
        x[own] = np.maximum(t[own] + q["least"][sel[own]], a + d * ((stop - length[own] - a) // d) + 1)
    while len(sel):
        most = q["t"][sel] + q["most"][sel]
        s = np.where(x <= most, successor(sel, x), -1)
        keep = (s >= 0) & (s <= most)
        sel, s, period, most = sel[keep], s[keep], period[keep], most[keep]
        if not len(sel):
            break
        t, length = q["t"][sel], q["len"][sel]
        last = s.copy()
        many = np.flatnonzero(period)
        if len(many):
            a, d = s[many], period[many]
            stop = a + d + classes.ahead(a, a + d)
            last[many] = a + d * ((stop - length[many] - a) // d)
        step = np.maximum(period, 1)
        count = (np.minimum(last, most) - s) // step + 1
        ts.append(np.repeat(t, count))
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ds.append(np.repeat(s - t, count) + nth * np.repeat(step, count))
        x = last + 1
    return (np.concatenate(ts), np.concatenate(ds)) if ts else (none, none)


def find_runs(ids: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run of every text, in order; positions over the whole batch.

    ``sizes``: words of each text; the sequence ``ids`` has them one after the other.  ``min_length``: 12 at least, as
    the shortest blocks find a period of up to 6 in no shorter run.
    """
    if min_length < MIN_LENGTH:
        raise ValueError(f"min_length below {MIN_LENGTH}")
    none = np.zeros(0, dtype=np.int64)
    if not len(ids):
        return none, none, none
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    end, begin = ends[text], (ends - sizes)[text]
    classes = Classes(ids, text, end)
    t, p = _candidates(classes, begin)
    if not len(t):
        return none, none, none
    start = t - classes.back(t, t + p, begin[t])
    stop = t + p + classes.ahead(t, t + p)
    keep = stop - start >= np.maximum(min_length, 2 * p)
    start, stop, p = start[keep], stop[keep], p[keep]
    by = np.lexsort((p, stop, start))
    start, stop, p = start[by], stop[by], p[by]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, p = start[new], stop[new], p[new]
    by = np.lexsort((p, start))
    return start[by], stop[by], p[by]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and the number of words of each text (null: none)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets, flat = lists.offsets.to_numpy(), lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return flat.filter(full), np.diff(before[offsets - offsets[0]])


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) where the words from a on repeat with period p, by the id's crc32, or None."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _batches(ids: pa.Array, texts: pa.Array):
    """The rows in stretches of some BATCH_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, side="right")))
        yield ids.slice(at, to - at).to_pylist(), texts.slice(at, to - at)
        at = to


Plant = Callable[[int | None, int], tuple[int, int] | None]


def _of_batch(doc_ids: list, texts: pa.Array, plant: Plant | None) -> dict:
    flat, sizes = split_words(texts)
    ends = np.cumsum(sizes)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if plant:
        source = np.arange(len(code))
        for k, (i, n) in enumerate(zip(doc_ids, sizes.tolist())):
            if found := plant(i, n):
                a, p = found
                b = int(ends[k]) - n
                source[b + a:b + n] = b + a + np.arange(n - a) % p
        code = code[source]
    start, stop, period = find_runs(code, sizes)
    text = np.searchsorted(ends, start, side="right")
    length, local = stop - start, start - (ends - sizes)[text]

    depth = np.zeros(len(code) + 1, dtype=np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, stop, -1)
    kept = np.cumsum(depth[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])
    offsets = np.concatenate([[0], before[ends]]).astype(np.int32)
    words = pa.DictionaryArray.from_arrays(pa.array(code[kept].astype(np.int32)), coded.dictionary).dictionary_decode()
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words), " ")

    n = len(doc_ids)
    counts = np.bincount(text, minlength=n)
    runs = [""] * n
    for k, s, m, p in zip(text.tolist(), local.tolist(), length.tolist(), period.tolist()):
        runs[k] += f"{s},{m},{p}\n"
    by = np.lexsort((period, start, -length, text))
    best = {}
    for at, k in zip(by.tolist(), text[by].tolist()):
        best.setdefault(k, at)

    def column(values):
        values = values.tolist()
        return [values[best[k]] if k in best else None for k in range(n)]

    return {"doc_id": doc_ids, "n_runs": counts, "start": column(local), "length": column(length), "period": column(period),
            "exponent_milli": column(1000 * length // np.maximum(period, 1)), "runs": runs, "collapsed": collapsed}


_SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs string, collapsed string")


def periodic_runs(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """Per document: its runs, the greatest one, and the text without repetitions.

    (doc_id, n_runs, start, length, period, exponent_milli of the longest run or null, ``runs``: one line
    ``start,length,period`` per run by start and period, ``collapsed``: the words that no run holds after its first
    period, joined by blanks).  ``plant(doc_id, words)`` may name (a, p): the words from a on are then taken to repeat
    the first p of them.
    """
    def make():
        def step(cols):
            texts = cols["text"]
            for ids, some in _batches(cols["doc_id"], texts):
                yield _of_batch(ids, some, plant)
        return step

    return map_arrow(id_and_text(docs), make, _SCHEMA)


def run_digests(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """:func:`periodic_runs` with sha256 digests (hex) in the place of ``runs`` and ``collapsed``."""
    def make():
        def sha(s: str) -> str:
            return hashlib.sha256(s.encode()).hexdigest()

        def step(cols):
            for ids, some in _batches(cols["doc_id"], cols["text"]):
                out = _of_batch(ids, some, plant)
                yield {**out, "runs_sha256": [sha(r) for r in out["runs"]], "collapsed_sha256": [sha(s) for s in out["collapsed"].to_pylist()]}
        return step

    schema = _SCHEMA.replace("runs string, collapsed string", "runs_sha256 string, collapsed_sha256 string")
    return map_arrow(id_and_text(docs), make, schema)
