import random
import zlib

import numpy as np

from rankfold.llm import toxicity

BAD = ["stupid", "moron", "loser", "worthless", "pathetic"]


def corpus(rng, n, long=300):
    out = []
    for i in range(n):
        w = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 9))) for _ in range(rng.randint(10, long))]
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * max(2, len(w) // 40)):
            b = rng.choice(BAD)
            w.insert(rng.randrange(len(w)), b if rng.random() < 0.7 else b + rng.choice(["s", "ly", "ness", "x"]))
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out_accuracy_and_unseen_misspellings():
    rng = random.Random(1)
    rows = corpus(rng, 900)
    model = toxicity.fit([t for _, t, _ in rows[:600]], np.array([y for _, _, y in rows[:600]], dtype=float))
    def logit(text):
        return model.logit(np.array([model.word(w) for w in toxicity.words_of(text)]))
    right = [(logit(t) >= 0) == y for _, t, y in rows[600:]]
    assert np.mean(right) > 0.95
    assert model.word("stupiddd") > 5 * abs(model.word("tinsel")) and model.word("morons") > 0


def test_batches_learn_and_drop(spark, docs_of, odd_rows):
    rows = corpus(random.Random(2), 500, 60)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    texts = [(i, t) for i, t, _ in rows]
    model = toxicity.learn(docs_of(texts), labels)
    again = toxicity.learn(docs_of(texts, parts=5), labels)
    assert (model.amount == again.amount).all() and model.bias == again.bias
    out = {r.doc_id: r for r in toxicity.score(docs_of(texts), model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    left = toxicity.drop_toxic(docs_of(texts), model)
    assert left.columns == docs_of(texts).columns
    assert {r.doc_id for r in left.collect()} == {i for i in out if not out[i].predicted}
    odd = toxicity.score(docs_of(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(r.score is not None for r in odd)


def test_no_labels_and_empty_table(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs_of([(1, "a b")]), none)
    assert [r.predicted for r in toxicity.score(docs_of([(1, "a b")]), model).collect()] == [0]
    assert toxicity.score(docs_of([(1, "a")]).limit(0), model).count() == 0


def test_bounded_sample(spark, docs_of):
    rows = corpus(random.Random(3), 200, 40)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    small = toxicity.learn(docs_of([(i, t) for i, t, _ in rows]), labels, max_rows=40, max_chars=3000)
    assert np.isfinite(small.amount).all()
