"""Operator 8, secret scans with a token-efficiency test.

Three base kinds are found by pattern.  The method adds a fourth, ``random``: runs of eight or more
characters of the usual key alphabets, letters alone too, for which the byte-pair vocabulary needs many
tokens.  Words and names take few tokens for their length because the vocabulary was made from them;
random strings take one for each one or two characters.  The shorter a run, the more the figure scatters
and the stricter its bound.  Runs that are a known digest (lower or upper hex digits of a digest's
length), a UUID, a number or a date are identifiers, not secrets, and left out, as is what overlaps a
base span.

Defined cases: a null text counts as empty and has no spans; positions are code points with the end
exclusive; rows with the same id are each scanned for themselves; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import id_and_text, map_arrow

#: The base kinds in their order, with the least length of a hit.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("passw", "secret", "token", "api")

#: Runs of the alphabets of keys.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Digests by their number of hex digits, UUIDs, dates with times, and numbers.
IDENTIFIER = re.compile(r"([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
                        r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9T:+/_=-]+Z?)", re.IGNORECASE)
#: A run is random below so many characters for each token.
CHARS_PER_TOKEN = 2.2
#: Runs of fewer characters than the first have the second as their bound; measured on clean text, see the README.
SHORTER = ((12, 1.3), (16, 1.6), (18, 1.8), (20, 2.0))


@lru_cache(maxsize=2)
def _encoding(blob: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, ``kind`` as its place in :data:`KINDS`."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def bound(length: int, chars_per_token: float) -> float:
    """Characters for each token below which a run of ``length`` is random."""
    return min([chars_per_token, *(b for n, b in SHORTER if length < n)])


def random_spans(text: str, taken: list[tuple[int, int, int]], count, chars_per_token: float) -> list[tuple[int, int, int]]:
    """Runs that meet no span of ``taken`` (in order) and have few characters for each token."""
    found, at, end = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():  # both lists are in order: each span is met once
            end = max(end, taken[at][2])
            at += 1
        run = m[0]
        if end > m.start() or IDENTIFIER.fullmatch(run):
            continue
        if len(run) < bound(len(run), chars_per_token) * count(run):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, vocabulary: str, chars_per_token: float = CHARS_PER_TOKEN, redact: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans; with ``redact`` also the text
    with every span replaced by that string (null stays null)."""
    with open(vocabulary, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, of fixed size

    def make():
        encoding = _encoding(blob.value)

        def count(run):
            return len(encoding.encode_ordinary(run))

        def step(cols):
            out = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "text")}
            for value in cols["text"]:
                text = value.as_py()
                base = sorted(base_spans(text or ""))
                spans = sorted(base + random_spans(text or "", base, count, chars_per_token))
                kinds = [k for _, k, _ in spans]
                for k in range(4):
                    out["n_" + KINDS[k]].append(kinds.count(k))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["text"].append(redacted(text, spans, redact) if redact is not None else None)
            yield out | {"doc_id": cols["doc_id"]}

        return step

    names = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"
    return map_arrow(id_and_text(docs, id_col, text_col), make, names + (", text string" if redact is not None else ""))


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``."""
    if not text or not spans:
        return text
    parts, at = [], 0
    for a, _, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact_documents(docs: DataFrame, vocabulary: str, mark: str = "[SECRET]", chars_per_token: float = CHARS_PER_TOKEN,
                     text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, in which every span is replaced; rows without spans stay as they are."""
    with open(vocabulary, "rb") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.udf("string")
    def clean(text):
        if not text:
            return text
        encoding = _encoding(blob.value)
        base = sorted(base_spans(text))
        spans = sorted(base + random_spans(text, base, lambda run: len(encoding.encode_ordinary(run)), chars_per_token))
        return redacted(text, spans, mark)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))
