import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rankfold.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return H(framed(r[0]), framed(r[3]), framed(r[2]), framed(r[4]), framed(text))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i, fold):
    siblings = ""
    for level in tree[:-1]:
        run, o = level[i // 16 * 16:i // 16 * 16 + 16], i % 16
        siblings += "".join(run[:o] + run[o + 1:])
        fold, i = H(*run[:o], fold, *run[o + 1:]), i // 16
    return siblings, fold


def expected(rows):
    trees = {}
    for r in rows:
        text = r[1]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(r[3], []).append((r[0], leaf_of(r, r[1]), leaf_of(r, text)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for s in order:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        low[s] = levels([x[1] for x in trees[s]])
    high = levels([low[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (d, leaf, changed) in enumerate(trees[s]):
            a, fold = path(low[s], i, changed)
            b, fold = path(high, k, fold)
            out.append((d, leaf, low[s][-1][0], high[-1][0], a + b, fold, fold == high[-1][0]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))


def proofs(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumn("_at", F.lit(1)).withColumn("tree", F.lit("x"))
    m = merkle.build(docs, merkle.tamper_every_fifth(docs))
    return m, merkle.climb(m)


def some_rows(n, sources, seed=1):
    rng = random.Random(seed)
    return [(i if rng.random() > 0.02 else None, rng.choice(["Ab c", None, "", "X" * 5000, "é T"]), rng.choice(["en", None]),
             rng.choice(sources), rng.choice([1, None])) for i in range(n)]


def test_proofs_equal_brute_force(spark):
    # a hot source, a null one, single leaves, repeated rows, null ids; more than 16 sources: two levels over the subroots
    rows = some_rows(1200, ["a"] * 60 + ["b", None, "é", "z"] + [f"s{k}" for k in range(20)])
    rows += [rows[3]] * 20 + [(5000, "T", "en", "alone", 1)]
    m, out = proofs(spark, rows)
    want = expected(rows)
    assert ordered(out.collect()) == ordered(want)
    assert m.root == want[0][3] and 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 256, 257])
def test_small_trees(spark, n):
    rows = [(i, f"Text {i}", "en", "s", 1) for i in range(n)]
    assert ordered(proofs(spark, rows)[1].collect()) == ordered(expected(rows))


def test_empty_table(spark):
    m, out = proofs(spark, [])
    assert m.root is None and out.collect() == []


def test_any_change_of_a_leaf_shows(spark):
    docs = spark.createDataFrame(some_rows(60, ["a", "b"]), SCHEMA)
    m = merkle.build(docs, F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text")))
    assert [r.doc_id for r in merkle.climb(m).where("NOT verified").collect()] == [7]


def test_climb_has_no_limit_of_rows(spark):
    rows = some_rows(400, ["a", "b"])
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10")
    try:
        assert proofs(spark, rows)[1].count() == 400
    finally:
        spark.conf.set(limit, before)
