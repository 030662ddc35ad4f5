import random

import numpy as np

from rankfold.llm import minhash
from rankfold.llm.components import components


def brute(rows, percent=85):
    """doc_id -> (sizes of its rows' sets, component), by comparing all pairs."""
    sets = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append((i, {tuple(w[a:a + 5]) for a in range(max(1, len(w) - 4))} if w else set()))
    group = {i: i for i, _ in sets if i is not None}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None, i is not None and find(i) == i) for i, s in sets), key=str)


def near_copies(rng, n, words, bases, edits):
    texts = [[rng.choice(words) for _ in range(rng.randint(30, 700))] for _ in range(bases)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w + passage * rng.randint(0, 1))))
    return rows


def check(docs_of, rows):
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_rows(docs_of, odd_rows):
    check(docs_of, odd_rows + [(4, "another text of the same id, with more words than five"), (9, "Another TEXT of the same id, with more words than five")])


def test_near_copies_equal_brute_force(docs_of):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    check(docs_of, near_copies(rng, 220, words, 9, 14))


def test_one_large_group_meets_in_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(7)
    check(docs_of, near_copies(rng, 120, [f"w{i}" for i in range(50)], 1, 9))


def test_a_copy_with_a_null_id_ahead_takes_no_sketch_away(spark):
    rng = random.Random(11)
    w = [f"w{rng.randrange(500)}" for _ in range(200)]
    near = w[:100] + ["changed"] + w[101:]
    rows = [(None, " ".join(w)), (1, " ".join(w)), (2, " ".join(near)), (None, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows) and [c for i, _, c, _ in got if i is not None] == [1, 1]


def test_empty_table(docs_of):
    assert minhash.near_duplicates(docs_of([(1, "x")]).limit(0)).count() == 0


def test_least_overlap_alike_in_spark_and_numpy(spark):
    from pyspark.sql import functions as F
    n = np.arange(6, 3000, 7)
    got = spark.createDataFrame([(int(x),) for x in n], "n long").select(minhash.least_overlap(F.col("n"), 256, 0.85).alias("o")).collect()
    assert [r.o for r in got] == minhash.least_overlaps(n.astype(float), 256, 0.85).astype(int).tolist()


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 300)] + [(7, 7), (9, 8)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 800)} == {500}
    assert got[9] == got[8] == 8 and 7 not in got
