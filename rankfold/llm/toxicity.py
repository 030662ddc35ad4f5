"""Operator 10, toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of itself and its character n-grams, hashed into a table of embeddings; a text is
the average of its words' bags; a linear softmax on that average gives the two classes.  Embeddings and
softmax are trained together in numpy on the driver, on a bounded sample of labelled texts (at most
``max_rows``, the first by hash of the id, and of these ``max_chars`` characters at most).  A misspelling
shares most of its n-grams, and so most of its vector, with the word it comes from.

Texts mix long harmless stretches with few hurtful words, which a plain average over the whole text
would drown.  Averages are therefore taken over stretches of ``span`` words (the whole text if
shorter), all of the whole text, and a text is as toxic as its most toxic stretch, in training too.

Because average and softmax are linear, a word adds a fixed amount to its stretch, its vector times
the softmax weights.  Workers remember these amounts by word, in a store of bounded size.

Defined cases: a null or empty text scores like a stretch without any word, that is by the bias alone;
ids and labels that are null are not learnt from; without labels of both classes every score is the
base rate (0 without any label); an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfold.llm.common import FEW_ROWS, discard, give_back, id_and_text, map_arrow, remembered, slices, stored
from rankfold.session import ship_package

#: Fit parameters; the sample on the driver is bounded by them.
MAX_ROWS = 6000
MAX_CHARS = 10_000_000
BUCKETS = 1 << 17
DIM = 8
SPAN = 8
EPOCHS = 12
CACHE_WORDS = 250_000

LETTERS = re.compile(r"[^\W_]+")


def bag(word: str, buckets: int = BUCKETS) -> list[int]:
    """Places of the whole word and of its 3- to 5-grams between boundary marks."""
    marked = f"<{word}>"
    grams = [marked] + [marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


def words_of(text: str | None) -> list[str]:
    """Words in lower case; a word said again and again in a row counts once."""
    words = LETTERS.findall(text.lower()) if text else []
    return words[:1] + [w for v, w in zip(words, words[1:]) if v != w]


@dataclass
class Model:
    """``amount[b]``: what bucket b adds to the logit of a bag; ``bias``; ``span``."""

    amount: np.ndarray
    bias: float
    span: int

    def word(self, word: str) -> float:
        return float(self.amount[bag(word, len(self.amount))].mean())

    def logit(self, amounts: np.ndarray) -> float:
        """Of a text whose words add ``amounts``."""
        n = len(amounts)
        if n == 0:
            return self.bias
        if n <= self.span:
            return float(amounts.mean()) + self.bias
        sums = np.concatenate([[0.0], np.cumsum(amounts)])
        return float((sums[self.span:] - sums[:-self.span]).max()) / self.span + self.bias


def fit(texts: list[str | None], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, span: int = SPAN,
        epochs: int = EPOCHS, rate: float = 2.0, seed: int = 1) -> Model:
    """Train embeddings and softmax together by Adagrad, one step for each batch of texts.

    In each epoch a text stands for its most toxic stretch under the model so far; in the first epochs,
    when the model knows nothing, for a stretch that rotates with the epoch.
    """
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        at = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(buckets), float(np.log(at / (1 - at))), span)
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int64) for t in texts]
    bags = [np.array(bag(w, buckets)) for w in number]
    size = np.array([len(b) for b in bags])
    first = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate(bags) if bags else np.zeros(0, dtype=np.int64)
    embed = rng.uniform(-1e-3, 1e-3, (buckets, dim))  # next to nothing, so that n-grams never seen add nothing
    soft = rng.choice([-1.0, 1.0], dim)
    bias = float(np.log(share / (1 - share)))
    seen, seen_soft, seen_bias = np.full(buckets, 1e-8), np.full(dim, 1e-8), 1e-8

    def word_vectors(ids):
        """Mean vector of each word in ``ids``, with the places and owners of their n-grams."""
        reps = size[ids]
        owner = np.repeat(np.arange(len(ids)), reps)
        place = flat[np.repeat(first[ids], reps) + np.arange(len(owner)) - np.repeat(np.cumsum(reps) - reps, reps)]
        return owner, place

    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        if epoch >= 2:
            amount = embed @ soft
            value = np.add.reduceat(amount[flat], first[:-1]) / size if len(flat) else np.zeros(0)
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
            stretches = []
            for d in batch:
                w = docs[d]
                if len(w) > span:
                    if epoch < 2:
                        a = int(rng.integers(0, len(w) - span + 1))
                        w = w if labels[d] == 1 else w[a:a + span]
                    else:
                        sums = np.concatenate([[0.0], np.cumsum(value[w])])
                        a = int(np.argmax(sums[span:] - sums[:-span]))
                        w = w[a:a + span]
                stretches.append(w)
            lengths = np.array([len(w) for w in stretches])
            ids, back = np.unique(np.concatenate(stretches), return_inverse=True) if lengths.sum() else (np.zeros(0, int), np.zeros(0, int))
            text_of = np.repeat(np.arange(len(batch)), lengths)
            share_of = 1.0 / np.maximum(lengths, 1)
            owner, place = word_vectors(ids)
            vectors = np.zeros((len(ids), dim))
            for k in range(dim):
                vectors[:, k] = np.bincount(owner, weights=embed[place, k], minlength=len(ids))
            vectors /= np.maximum(size[ids], 1)[:, None]
            mean = np.zeros((len(batch), dim))
            for k in range(dim):
                mean[:, k] = np.bincount(text_of, weights=vectors[back, k] * share_of[text_of], minlength=len(batch))
            p = 1 / (1 + np.exp(-np.clip(mean @ soft + bias, -30, 30)))
            error = (p - labels[batch]) * weight[batch]
            # the gradient of an n-gram is its softmax direction times the errors of the texts it is in
            g_word = np.bincount(back, weights=(error * share_of)[text_of], minlength=len(ids)) / np.maximum(size[ids], 1)
            touched, inverse = np.unique(place, return_inverse=True)
            g = np.bincount(inverse, weights=g_word[owner], minlength=len(touched))
            seen[touched] += g * g
            embed[touched] -= rate * (g / np.sqrt(seen[touched]))[:, None] * soft
            g_soft, g_bias = error @ mean / len(batch), float(error.mean())
            seen_soft += g_soft ** 2
            seen_bias += g_bias ** 2
            soft -= 0.1 * g_soft / np.sqrt(seen_soft)
            bias -= 0.1 * g_bias / np.sqrt(seen_bias)
    return Model(embed @ soft, bias, span)


def held_out(doc_id) -> "F.Column":
    """Rows that nothing is learnt from: crc32 of the id as text divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, **how) -> Model:
    """Fit on a sample of labelled rows that are not held out, bounded by rows and characters.

    The rows are the first by hash of the id; a text that would pass the bound is left out whole.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    sample = stored(id_and_text(docs).join(F.broadcast(chosen), "doc_id"), "labelled")  # at most max_rows ids
    sizes = sample.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    kept, total = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id")).collect():
        if total + r["n"] <= max_chars:
            kept.append(r["doc_id"])
            total += r["n"]
    rows = sample.where(F.col("doc_id").isin(kept)).collect() if kept else []
    rows = sorted((r["doc_id"], r["toxic"], r["text"] or "") for r in rows)
    discard(sample)
    return fit([t for _, _, t in rows], np.array([y for _, y, _ in rows], dtype=float), **how)


def _scorer(shared, key: int):
    """A function from an Arrow column of texts to scores, with a store of words for this Python worker."""
    known, model = remembered(f"toxic-{key}", dict), shared.value

    def amounts(words):
        got = list(map(known.get, words))
        if None in got:
            if len(known) > CACHE_WORDS:
                known.clear()
            fresh = {w: model.word(w) for w in {w for w, g in zip(words, got) if g is None}}
            known.update(fresh)
            got = [fresh[w] if g is None else g for w, g in zip(words, got)]
        return np.array(got, dtype=float)

    def run(texts):
        logits = np.array([model.logit(amounts(words_of(t.as_py()))) for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))

    return run


def _share(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model), zlib.crc32(model.amount.tobytes())  # one number for each bucket


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on) of every whole text."""
    shared, key = _share(docs, model)

    def make():
        scores = _scorer(shared, key)

        def step(cols):
            p = scores(cols["text"])
            yield {"doc_id": cols["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return step

    return map_arrow(id_and_text(docs, id_col, text_col), make, "doc_id bigint, score double, predicted int", remembers=True)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below one half."""
    ship_package(docs.sparkSession)
    shared, key = _share(docs, model)

    def run(batches):
        scores = _scorer(shared, key)
        for whole in batches:
            for batch in slices(whole, FEW_ROWS):
                yield batch.filter(pa.array(scores(batch.column(batch.schema.get_field_index(text_col))) < 0.5))
        whole = batch = None
        give_back()

    return docs.mapInArrow(run, docs.schema)
