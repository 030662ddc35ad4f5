"""Operator 2, quality rules with a test of divergence from language references.

Base rules count words, symbols, repeated lines and repeated five-word windows.  The method then
compares two histograms of a document with the reference of its language, by Jensen-Shannon distance
(base 2, so between 0 and 1):

* character classes (lower and upper case, digits, blanks, line ends, punctuation, symbols, the rest);
* common words, each with its own bin, and one bin for all other words.

A language's reference is made of all its documents: the mean of their class shares, and the mean shares
of the words for which it is at least ``COMMON``, so that a very long document weighs no more than others.
Languages with less than ``RARE`` of all documents or fewer than ``LEAST``, and null, use the reference of
all documents together, so the references are of bounded size.
Short documents have noisy histograms, so below a length either test says nothing.

Defined cases: a null or empty text has no words and fails the base rule; rows with the same id are
judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import map_arrow

SPACE = b" \t\n\v\f\r"
#: The same for Spark.
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "blank", "line", "punctuation", "symbol", "other")

#: Least share of a language's words for a word to be common, and least share of documents for a language.
COMMON = 0.002
RARE = 0.001
#: Least number of documents for a language, and of occurrences for a common word.
LEAST = 20
#: A document's weight, dealt out to its words in whole numbers, which add up alike in any order.
WEIGHT = 1_000_000_000
#: Guards: visible characters for the class test, words for the word test.
MIN_CHARS = 200
MIN_WORDS = 40
#: A document farther than this from its reference is not kept.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.42


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "Nd": 2, "Zs": 3, "Lo": 7, "Lm": 7}
    table = np.full(0x110000, 7, dtype=np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))
        table[c] = kinds.get(k, 5 if k[0] == "P" else 6 if k[0] == "S" else 7)
    table[[9]] = 3
    table[[10, 11, 12, 13]] = 4
    table[list(SYMBOLS)] = 6
    return table


def class_shares(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.bincount(class_table()[points], minlength=len(CLASSES)) / max(1, len(points))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms that add up to 1."""
    m = (p + q) / 2
    a, b = p > 0, q > 0
    d = 0.5 * (p[a] * np.log2(p[a] / m[a])).sum() + 0.5 * (q[b] * np.log2(q[b] / m[b])).sum()
    return float(np.sqrt(max(0.0, d)))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, dup = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), word_chars, symbols, dup, repeat_words(words)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    key = ids[:n].copy()
    for k in range(1, width):  # wraps around; equal windows have equal keys
        key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, dtype=bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    windows = [tuple(words[i:i + width]) for i in at]
    times = Counter(windows)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in zip(at, windows):
        if times[w] > 1:
            inside[i] += 1
            inside[i + width] -= 1
    return int((np.cumsum(inside) > 0).sum())


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """lang (None: all) -> (class shares, common words, their shares with the rest last)."""
    frame = docs.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def make():
        def step(cols):
            sums: dict = {}
            for lang, value in zip(cols["lang"].to_pylist(), cols["text"]):
                text = value.as_py()
                if text:
                    own = sums.setdefault(lang, np.zeros(len(CLASSES) + 2))
                    own[:-2] += class_shares(text)
                    own[-2] += 1
                    own[-1] += bool(text.strip(SPACE.decode()))
            yield {"lang": list(sums), "sums": [v.tolist() for v in sums.values()]}
        return step

    parts = map_arrow(frame, make, "lang string, sums array<double>")
    wide = len(CLASSES) + 2
    # whole numbers would add up alike in any order; rounding the shares' sums makes these do so too
    by_lang = parts.groupBy("lang").agg(*(F.sum(F.round(F.col("sums")[i] * 1e6)).alias(f"s{i}") for i in range(wide)))
    every = by_lang.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(wide))).collect()[0]
    if not every[wide - 2]:
        return {}
    kept = by_lang.where(F.col("lang").isNotNull() & (F.col(f"s{wide - 2}") >= max(RARE * every[wide - 2], LEAST * 1e6))).collect()
    sums = {r["lang"]: np.array(r[1:], dtype=float) / 1e6 for r in kept} | {None: np.array(every, dtype=float) / 1e6}

    words = frame.select("lang", F.array_remove(F.split(F.lower("text"), SPLIT), "").alias("words"))
    words = words.select("lang", F.explode("words").alias("word"), F.floor(F.lit(WEIGHT) / F.size("words")).alias("w"))
    often = (F.sum("w").alias("weight"), F.count("*").alias("n"))
    bars = docs.sparkSession.createDataFrame([(k, float(COMMON * WEIGHT * v[-1])) for k, v in sums.items() if k is not None], "lang string, bar double")
    common = words.groupBy("lang", "word").agg(*often).join(F.broadcast(bars), "lang").where("weight >= bar").select("lang", "word", "weight", "n")  # at most 1 / RARE languages
    total = words.groupBy("word").agg(*often).where(F.col("weight") >= COMMON * WEIGHT * sums[None][-1]).select(F.lit(None).cast("string").alias("lang"), "word", "weight", "n")
    out = {}
    rows = common.unionByName(total).where(F.col("n") >= LEAST).collect()  # at most 1 / COMMON words for each
    for lang, s in sums.items():
        own = sorted(((r["weight"], r["word"]) for r in rows if r["lang"] == lang), reverse=True)
        shares = np.array([n for n, _ in own], dtype=float) / max(1.0, WEIGHT * s[-1])
        out[lang] = (s[:-2] / s[:-2].sum(), {w.encode(): i for i, (_, w) in enumerate(own)}, np.append(shares, max(0.0, 1 - shares.sum())))
    return out


def divergence(text: str, reference: tuple) -> tuple[float | None, float | None]:
    """Class and word distance of a text; None where it is too short to tell."""
    classes, place, shares = reference
    by_class = distance(class_shares(text), classes) if len(text) >= MIN_CHARS else None
    words = text.lower().encode("utf-8", "replace").split()  # at the white space of base_counts
    if len(words) < MIN_WORDS:
        return by_class, None
    rest = len(place)
    hist = np.bincount(np.fromiter((place.get(w, rest) for w in words), dtype=np.int64, count=len(words)), minlength=rest + 1)
    return by_class, distance(hist / len(words), shares)


def quality(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE,
            id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, class_distance, word_distance (null: too short) and kept of every row."""
    known = docs.sparkSession.sparkContext.broadcast(references(docs, text_col, lang_col))  # bounded by RARE and COMMON
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        reference = known.value

        def step(cols):
            out = {n: [] for n in (*names, "base_failed", "class_distance", "word_distance", "kept")}
            for lang, value in zip(cols["lang"].to_pylist(), cols["text"]):
                text = value.as_py() or ""
                counts = base_counts(text)
                failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
                by_class, by_word = divergence(text, reference[lang] if lang in reference else reference[None]) if text else (None, None)
                far = (by_class or 0) > max_class_distance or (by_word or 0) > max_word_distance
                for n, v in zip(out, (*counts, failed, by_class, by_word, not failed and not far)):
                    out[n].append(v)
            yield out | {"doc_id": cols["doc_id"]}

        return step

    return map_arrow(frame, make, "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names)
                     + ", base_failed boolean, class_distance double, word_distance double, kept boolean")
