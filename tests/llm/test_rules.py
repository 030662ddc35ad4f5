import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers

from rankfold.llm import quality, secrets

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    covered = {k for i, g in enumerate(grams) if times[g] > 1 for k in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts():
    rng = random.Random(1)
    alphabet = ["a", "b", "c", " ", " ", "\n", "\t", "\r", "\x85", "\xa0", "#", "é", "\x0b", "*"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert quality.base_counts(text) == base(text)


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=7)) for _ in range(n))


def test_quality_keeps_prose_and_drops_divergent_texts(docs_of, odd_rows):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(20, 300)).capitalize() + ".") for i in range(100, 200)]
    junk = [(200, prose(rng, 100).upper()), (201, " ".join(w + "%%%$$" for w in prose(rng, 100).split())), (202, " ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(200)))]
    out = quality.quality(docs_of(odd_rows + rows + junk)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == Counter((i, *base(t or "")) for i, t in odd_rows + rows + junk)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        if r.doc_id and r.doc_id >= 100:
            assert r.kept == (r.doc_id < 200), r
        else:
            assert not (r.kept and r.base_failed)
    assert quality.quality(docs_of(rows).limit(0)).count() == 0


def test_short_texts_and_other_languages_have_a_reference(docs_of):
    from pyspark.sql import functions as F
    rng = random.Random(3)
    docs = docs_of([(i, prose(rng, 60)) for i in range(50)]).withColumn("lang", F.when(F.col("doc_id") == 3, F.lit(None)).when(F.col("doc_id") > 4, F.lit("xx")).otherwise(F.lit("yy")))
    out = quality.quality(docs).collect()
    assert all(r.kept and r.word_distance is not None and r.class_distance is not None for r in out)


def test_distance():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert quality.distance(a, a) == 0 and abs(quality.distance(a, b) - 1) < 1e-12


def spans(text):
    """Base spans by the patterns as they are stated."""
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)]


def test_base_spans_on_random_texts():
    rng = random.Random(4)
    alphabet = ["password", "TOKEN", "api_key", "apikey", "Secret", "passwd", "=", ":", " ", "'", '"', "abcdefgh", "0123456789abcdef" * 2, "AKIA", "AKIAABCDEFGH1234", "Z9", "é", "\n", "ſecret", "toKen", "f"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert secrets.joined(sorted(secrets.base_spans(text))).split(",") == (spans(text) or [""])


def test_scan(docs_of, odd_rows):
    key = "q7Xw9ZpL2vKd8RtY4mNb6HsF3jGc"
    rows = odd_rows + [(20, f"user key {key} here"), (21, "password = hunter2hunter2"), (22, "id 123e4567-e89b-12d3-a456-426614174000 and 2024-01-01T00:00:00Z-123456 x"),
                       (23, "DIGEST " + "AB12" * 10), (24, "internationalisation-of-documentation2 is long prose"), (25, "a" * 31 + " " + "b" * 32)]
    out = {r.doc_id: r for r in secrets.scan_secrets(docs_of(rows), VOCABULARY, redact="[X]").collect() if r.doc_id is not None}
    for i, t in rows:
        if i in out and i != 4:
            assert [s for s in out[i].spans.split(",") if s and not s.startswith("random")] == spans(t or "")
            assert out[i].base_sha256 == hashlib.sha256(",".join(spans(t or "")).encode()).hexdigest()
    assert out[20].spans == f"random:9:{9 + len(key)}" and out[20].text == "user key [X] here"
    assert all(out[i].n_random == 0 for i in (1, 2, 3, 5, 6, 8, 21, 22, 23, 24, 25)) and out[25].n_hex == 1
    assert out[21].text == "[X]" and out[1].text is None and out[2].text == ""
    assert secrets.scan_secrets(docs_of(rows).limit(0), VOCABULARY).count() == 0
    clean = {r.doc_id: r for r in secrets.redact_documents(docs_of(rows), VOCABULARY).collect()}
    assert clean[20].text == "user key [SECRET] here" and clean[22].text == dict(rows)[22] and clean[1].text is None


def test_overlapping_spans_are_cut_once():
    assert secrets.redacted("abcdefghij", [(1, 0, 5), (3, 2, 7), (8, 3, 9)], "_") == "a_h_j"


def test_words_end_at_any_white_space_and_all_code_points_have_a_class(docs_of):
    rng = random.Random(9)
    rows = [(i, prose(rng, 120).replace(" ", " \n\t\r\v\f"[i % 6])) for i in range(60)]
    junk = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(300)]
    rows += [(100 + k, space.join(junk)) for k, space in enumerate([" ", "\n", "\t", "\r\n"])]
    out = {r.doc_id: r for r in quality.quality(docs_of(rows)).collect()}
    assert all(r.word_distance is not None for r in out.values())
    assert len({round(out[100 + k].word_distance, 9) for k in range(4)}) == 1
    assert all(out[i].kept == (i < 100) for i in out)
    names = {c: quality.CLASSES[quality.class_table()[ord(c)]] for c in "\U0001f600，。Ａａ１漢\u3000"}
    assert list(names.values()) == ["symbol", "punctuation", "punctuation", "upper", "lower", "digit", "other", "blank"]


def test_random_strings_of_all_alphabets_and_lengths():
    import string
    rng = random.Random(6)
    with open(VOCABULARY, "rb") as f:
        encoding = secrets._encoding(f.read())
    count = lambda run: len(encoding.encode_ordinary(run))
    found = lambda run: secrets.random_spans(f"a {run} b", [], count, secrets.CHARS_PER_TOKEN) == [(2, 3, 2 + len(run))]
    letters, digits = string.ascii_letters, string.digits
    # least recall by alphabet and length
    for alphabet, floors in ((letters, {12: 0.8, 16: 0.95, 20: 0.99, 64: 0.99}), (letters + digits, {12: 0.9, 16: 0.95, 20: 0.99, 64: 0.99}),
                             (string.ascii_lowercase, {16: 0.8, 20: 0.95, 64: 0.99}), (letters + digits + "+/", {12: 0.9, 16: 0.95, 20: 0.99})):
        for n, floor in floors.items():
            assert sum(found("".join(rng.choices(alphabet, k=n))) for _ in range(400)) >= floor * 400, (alphabet, n)
    for word in ("internationalisation", "Documentation", "characteristics", "straightforward-implementation", "2024-01-01T00:00:00Z", "12345678901234567890", "=" * 30):
        assert not found(word)


def test_random_spans_are_linear_and_keep_off_base_spans():
    """100,000 assignments in one text: each base span is met once; what lies between them is found."""
    def count(run):
        return len(run)

    line = 'password = "hunter2hunter2" xkQz9RtLwP2mVb7nYc '
    text = line * 100_000
    base = sorted(secrets.base_spans(text))
    began = time.time()
    found = secrets.random_spans(text, base, count, 2.2)
    assert time.time() - began < 20
    assert len(base) == 100_000 and [a for a, _, _ in found] == [k * len(line) + line.index("xkQz") for k in range(100_000)]
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["abcdefgh", " ", "AKIA" + "Q" * 14, "token=abcdefghij", "0" * 9, "f" * 33, "'"]) for _ in range(12))
        base = sorted(secrets.base_spans(text))
        want = [(m.start(), 3, m.end()) for m in secrets.RUN.finditer(text)
                if not secrets.IDENTIFIER.fullmatch(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base)]
        assert secrets.random_spans(text, base, count, 2.2) == want
