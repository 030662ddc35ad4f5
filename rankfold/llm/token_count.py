"""Operator 6, token counts by count-only Viterbi.

An Aho-Corasick automaton over the pieces enumerates all matches of a word in one pass.  Dynamic
programming carries, for each end, the best score and its number of pieces; no back pointers and no
strings are made.  See :mod:`rankfold.llm.unigram` for the model and its tie rules.  A Python worker
remembers the counts of words, in two generations of bounded size.

Defined cases: a null or empty text has no tokens and score 0; white space counts as the tokenizer
spells it; rows with the same id are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankfold.llm import unigram
from rankfold.llm.common import id_and_text, map_arrow, remembered

CACHE_WORDS = 300_000


class PieceCounter:
    """Number of pieces and score of whole texts."""

    def __init__(self, pieces: tuple, unknown: float):
        import ahocorasick

        self.automaton, self.unknown = ahocorasick.Automaton(), unknown
        for piece, score, _ in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.young: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best path of a word that has its blank."""
        ends: list[list] = [[] for _ in word]
        for last, match in self.automaton.iter(word):  # of one end the longest first
            ends[last].append(match)
        score, count = [0.0], [0]
        for at, matches in enumerate(ends):
            best, pieces, length = None, 0, 0
            for length, own in matches:
                s = score[at + 1 - length] + own
                if best is None or s > best:
                    best, pieces = s, count[at + 1 - length] + 1
            if length != 1:  # no piece of this character alone
                s = score[at] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[at] + len(word[at].encode("utf-8", "surrogatepass"))
            score.append(best)
            count.append(pieces)
        return count[-1], score[-1]

    def _learn(self, parts: set[str]) -> None:
        if len(self.young) + len(parts) > CACHE_WORDS:
            self.young, self.old = {}, self.young
        for part in parts:
            got = self.old.get(part)
            self.young[part] = got or self.word(part if part[:1] == "\n" else unigram.BLANK + part.replace(" ", unigram.BLANK))

    def text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = text.replace("\n", " \n").split(" ")  # a part has the blank before it, or else begins with a line feed
        got = list(map(self.young.get, parts))
        if None in got:
            self._learn({p for p, g in zip(parts, got) if g is None})
            got = [self.young[p] if g is None else g for p, g in zip(parts, got)]
        return sum([g[0] for g in got]), sum([g[1] for g in got])


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, score (sum of the piece scores of the best segmentation) of every text."""
    pieces, unknown, _ = unigram.vocabulary(model_path)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, unknown))  # the vocabulary, of fixed size

    def make():
        counter = remembered(f"count-{model_path}", lambda: PieceCounter(*shared.value))

        def step(cols):
            got = [counter.text(t.as_py()) for t in cols["text"]]
            yield {"doc_id": cols["doc_id"], "n_tokens": [n for n, _ in got], "score": [s for _, s in got]}

        return step

    return map_arrow(id_and_text(docs, id_col, text_col), make, "doc_id bigint, n_tokens bigint, score double", remembers=True)
