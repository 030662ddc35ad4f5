import random
import time

import public_tokenizers
from pyspark.sql import functions as F

from rankfold.llm import lattice, token_count, unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(seed, n):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "\n", "a", "the", "é", "1", "22", "'s", "!!", "\t", "漢", "x", "字", "ing", "er", ".", "\U0001f600", "▁", "tion"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_documents_equal_the_library(docs_of):
    library = unigram.library_model(PATH)
    rows = list(enumerate(texts(1, 150))) + [(1000, None), (1001, "")]
    got = {r.doc_id: r.ids for r in lattice.encode_documents(docs_of(rows), PATH).collect()}
    assert got == {i: None if t is None else library.encode(t) for i, t in rows}


def test_words_decode_to_themselves_and_count_all_occurrences(docs_of):
    rows = list(enumerate(texts(2, 80)))
    out = lattice.encode_vocabulary(docs_of(rows), PATH).collect()
    wanted = {}
    for _, t in rows:
        for w in t.replace("\n", " \n").split(" ") if t else []:
            wanted[w] = wanted.get(w, 0) + 1
    assert {r.word: r.n for r in out} == wanted and len(out) == len(wanted)
    assert all(r.decoded == (r.word if r.word.startswith("\n") else " " + r.word).replace("▁", " ") for r in out)


def test_odd_rows(docs_of, odd_rows):
    library = unigram.library_model(PATH)
    rows = odd_rows + [(50, "long" * 700)]
    got = {(r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in lattice.encode_documents(docs_of(rows), PATH).collect()}
    assert got == {(i, None if t is None else tuple(library.encode(t))) for i, t in rows}
    assert lattice.encode_vocabulary(docs_of(rows).limit(0), PATH).count() == 0


def test_plan_counts_words_once_and_needs_no_python(docs_of):
    plan = lattice.encode_vocabulary(docs_of([(1, "a b")]), PATH)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_token_counts_equal_the_library(docs_of, odd_rows):
    library = unigram.library_model(PATH)
    rows = odd_rows + list(enumerate(texts(3, 300), 100))
    got = sorted(((r.doc_id, r.n_tokens) for r in token_count.count_tokens(docs_of(rows), PATH).collect()), key=str)
    assert got == sorted(((i, len(library.encode(t or ""))) for i, t in rows), key=str)
    assert token_count.count_tokens(docs_of(rows).limit(0), PATH).count() == 0


def test_counts_and_lattice_agree_on_scores(docs_of):
    rows = list(enumerate(texts(4, 60)))
    words = {r.word: (r.n_pieces, r.score) for r in lattice.encode_vocabulary(docs_of(rows), PATH).collect()}
    for r in token_count.count_tokens(docs_of(rows), PATH).where(F.col("n_tokens") > 0).collect():
        own = [words[w] for w in rows[r.doc_id][1].replace("\n", " \n").split(" ")]
        assert (sum(n for n, _ in own), sum(s for _, s in own)) == (r.n_tokens, r.score)


def test_query_encodes_and_decodes_whole_documents(spark, tmp_path, monkeypatch):
    from rankfold.llm import queries
    library = unigram.library_model(PATH)
    rows = list(enumerate(texts(5, 120))) + [(7, texts(5, 120)[7]), (500, None), (501, ""), (502, "the " * 900), (None, "\nno id"), (503, "a ▁ b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    wanted = sorted({(i, None if t is None else tuple(library.encode(t)), None if t is None else "▁" not in t) for i, t in rows}, key=str)
    for hot in (1, 20, 20_000):  # few words, some and all are broadcast
        monkeypatch.setattr(lattice, "HOT", hot)
        out = queries.op4_sentencepiece(spark, str(tmp_path)).collect()
        assert sorted(((r.doc_id, None if r.ids is None else tuple(r.ids), r.decodes) for r in out), key=str) == wanted
        assert all(r.n_pieces == (None if r.ids is None else len(r.ids)) for r in out)
    plan = queries.op4_sentencepiece(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_long_words_take_linear_work(docs_of):
    """Words of 100,000 characters, known, unknown and mixed, in blocks: the same as the library, in seconds."""
    library = unigram.library_model(PATH)
    rng = random.Random(9)
    rows = [(1, "ab" * 50_000), (2, "\U0001f600\t" * 300 + "x" * 99_400), (3, "".join(rng.choice("aeinorst漢\x01'") for _ in range(100_000)) + " and more")]
    began = time.time()
    got = {r.doc_id: (r.ids, r.decodes) for r in lattice.encode_documents(docs_of(rows), PATH).collect()}
    assert time.time() - began < 90
    assert got == {i: (library.encode(t), True) for i, t in rows}
    words = {r.word: r.ids for r in lattice.encode_vocabulary(docs_of(rows[:1]), PATH).collect()}
    assert words == {rows[0][1]: library.encode(rows[0][1])}


def test_words_around_block_edges(docs_of):
    library = unigram.library_model(PATH)
    rows = [(n, ("international" * 60)[:n]) for n in range(lattice.BLOCK - 18, lattice.BLOCK + 18)] + [(n, "é漢" * (n // 2)) for n in range(508, 516)]
    got = {r.doc_id: r.ids for r in lattice.encode_documents(docs_of(rows), PATH).collect()}
    assert got == {i: library.encode(t) for i, t in rows}


def test_texts_are_exchanged_once(docs_of):
    """Rare words are encoded in the partitions of their documents: one exchange by document, used twice."""
    out = lattice.encode_documents(docs_of([(1, "a rare word")] * 2), PATH)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and all("REPARTITION_BY_NUM" in line for line in exchanges), exchanges


def test_broadcast_words_fill_their_bytes(docs_of, monkeypatch):
    """Rare words are broadcast too while there is room, the most frequent ones first, and never more than HOT bytes."""
    pairs = [f"rare{i}" for i in range(50)]
    docs = docs_of([(1, " ".join(["common"] * 5000 + pairs)), (2, " ".join(["often"] * 40 + pairs + ["once"]))])
    monkeypatch.setattr(lattice, "HOT", 20_000)
    assert sorted(r.word for r in lattice.frequent_words(docs).collect()) == sorted(["common", "often", *pairs])
    monkeypatch.setattr(lattice, "HOT", 1_000)
    some = {r.word for r in lattice.frequent_words(docs).collect()}
    assert {"common", "often"} < some and sum(2 * len(w) + lattice.HOT_ROW for w in some) <= 1_000
    monkeypatch.setattr(lattice, "HOT", 10)
    assert lattice.frequent_words(docs).count() == 0


def test_lattice_has_no_beaten_pieces(spark):
    """Pieces that others beat in their place are no edges; the best paths with and without them are the same."""
    pieces, unknown, _ = unigram.vocabulary(PATH)
    won, penalty = unigram.winners(PATH)
    library = unigram.library_model(PATH)
    assert penalty == unknown and set(won) < set(pieces) and {p for p, _, _ in pieces if len(p) == 1} <= {p for p, _, _ in won}
    beaten = sorted(set(pieces) - set(won))[::400]
    assert all(i not in library.encode(p.replace(unigram.BLANK, " ")) for p, _, i in beaten)
    spelt = [p.replace(unigram.BLANK, "") for p, _, _ in beaten]
    words = spark.createDataFrame(list(enumerate(["x" * 20 + w + "x" * 300 + w for w in spelt if w])), "at int, word string").repartition(2, "at")
    edges = lattice.lattice(words, ["at"], PATH).collect()
    lost = {i for _, _, i in set(pieces) - set(won)}
    assert len(edges) == words.count() and not any(e.id in lost for r in edges for e in r.edges)
    got = {r.at: r.ids for r in lattice.encode_words(words, ["at"], PATH).collect()}
    assert got == {r.at: library.encode(r.word) for r in words.collect()}


def test_a_piece_is_beaten_only_by_a_strictly_better_path(monkeypatch):
    table = [("a", -10.0, 1), ("b", -10.0, 2), ("ab", -20.0, 3), ("ba", -21.0, 4), ("abab", -40.0, 5), ("baba", -42.0, 6), ("a\u00e9", -29.0, 7), ("\u00e9a", -31.0, 8)]
    monkeypatch.setattr(unigram, "vocabulary", lambda _: (table, -20.0, 0))
    assert [i for _, _, i in unigram.winners.__wrapped__("x")[0]] == [1, 2, 3, 5, 7]
