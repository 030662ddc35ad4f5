import hashlib
import random

import numpy as np
import pytest

from rankfold.llm import periods


def brute(w, least=periods.MIN_LENGTH):
    best = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, 2 * p):
                best.setdefault((s, i + p), p)
    return sorted(((s, e, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def sequence(rng):
    kinds, n, mode = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 1, 5, 12, 13, 30, 60, 200]), rng.random()
    if mode < 0.3:
        return [rng.randrange(kinds) for _ in range(n)]
    if mode < 0.7:
        out = []
        while len(out) < n:
            u = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 31]))]
            m = rng.choice([1, 2, 3, 5, 9])
            out += (u * m)[:len(u) * m - rng.randrange(len(u))]
        return out
    a, b = [0], [0, 1]  # Fibonacci words have the most runs
    while len(b) < n:
        a, b = b, b + a
    b = b[:n]
    for _ in range(rng.choice([0, 1, 3])):
        if b:
            b[rng.randrange(len(b))] = rng.randrange(3)
    return b


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng, found = random.Random(seed), 0
    for _ in range(80):
        texts = [sequence(rng) for _ in range(rng.choice([1, 3, 10]))]
        want, at = [], 0
        for w in texts:
            want += [(s + at, e + at, p) for s, e, p in brute(w)]
            at += len(w)
        got = periods.find_runs(np.array([x for w in texts for x in w], dtype=np.int64), np.array([len(w) for w in texts]))
        assert [tuple(int(x) for x in r) for r in zip(*got)] == want
        found += len(want)
    assert found > 300


@pytest.mark.parametrize("period", [1, 6, 7, 14, 15, 30, 31, 62, 63, 300, 499, 1000])
def test_every_period_has_a_level(period):
    rng = random.Random(period)
    u = [rng.randrange(1000) for _ in range(period)]
    for extra in (0, 1, period // 2):
        length = max(12, 2 * period + extra)
        w = [2000, 2001, 2002][:rng.randrange(4)] + (u * 13)[:length] + [3000, 3001]
        s, e, p = periods.find_runs(np.array(w), np.array([len(w)]))
        assert [tuple(int(x) for x in r) for r in zip(s, e, p)] == brute(w) and len(s) >= 1


def test_wavelet_successor():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 64, 300):
        values = rng.permutation(n)
        m = periods.Wavelet(values)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(0, n + 1, 200))
        x = rng.integers(0, n + 2, 200)
        want = [min((v for v in values[a:b] if v >= y), default=-1) for a, b, y in zip(lo, hi, x)]
        assert m.successor(lo, hi, x).tolist() == want


def words_after(doc_id, text, plant):
    w = (text or "").encode().split()
    found = plant(doc_id, len(w)) if plant else None
    if found:
        a, p = found
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    return w


def expected(doc_id, text, plant):
    w = words_after(doc_id, text, plant)
    runs = brute(w)
    dropped = {i for s, e, p in runs for i in range(s + p, e)}
    top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    best = (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2]) if top else (None,) * 4
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in runs)
    text = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), *best, lines, text.decode())


def test_documents_with_and_without_plants(docs_of, odd_rows):
    rng = random.Random(5)
    rows = [(100 + i, " ".join(f"w{x}" for x in sequence(rng))) for i in range(120)]
    rows += [r for r in odd_rows if r[0] != 5] + [(300, "a\tb\x0bc\x0cd\re\n" * 9), (301, "\x1ca b\x85c " * 20)]
    docs = docs_of(rows)
    for plant in (None, periods.planted):
        got = sorted((tuple(r) for r in periods.periodic_runs(docs, plant).collect()), key=str)
        want = [expected(i, t, plant) for i, t in rows]
        assert got == sorted(want, key=str)
        digests = sorted(((r.doc_id, r.runs_sha256, r.collapsed_sha256) for r in periods.run_digests(docs, plant).collect()), key=str)
        assert digests == sorted(((r[0], hashlib.sha256(r[6].encode()).hexdigest(), hashlib.sha256(r[7].encode()).hexdigest()) for r in want), key=str)
    assert any(periods.planted(i, len((t or "").split())) for i, t in rows)


def test_very_long_text_and_empty_table(docs_of):
    text = "one two three " * 100_000 + "x " * 50_000 + "end"
    r = periods.periodic_runs(docs_of([(1, text)])).collect()[0]
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 0, 300_000, 3, 100_000_000)
    assert r.collapsed == "one two three x end"
    assert periods.periodic_runs(docs_of([])).collect() == []
