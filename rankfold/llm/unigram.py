"""A SentencePiece vocabulary as a unigram model, shared by operators 4 and 6.

The vocabulary file at hand holds a byte-pair model.  The operators use its pieces and scores as a
unigram model, that is, they find the segmentation with the largest sum of scores.  Pieces which the
file marks as unusable by a score of -10^9 (runs of blanks) are left out: added up in float32, such a
score hides all others, and they can never win.  The lone blank, marked so too, is needed to spell any
text and takes the least usable score.

Rules of the library's Viterbi search: starts rise, a path replaces another with the same end only if
it is strictly better, so that of equal paths the one whose last piece is the longest stays; a character
without a piece of its own costs the least score minus 10 and is spelt as bytes.

No piece that is left holds a blank but as its first character, so the best path of a text is the best
paths of its words, each with the blank before it (the first has a dummy blank).  A line feed is in no
piece at all and is cut at too.  Scores are whole numbers and added exactly, while the library rounds
sums to float32, which differs only where a text's sum passes 2^24.
"""

from __future__ import annotations

from functools import lru_cache

BLANK = "▁"
UNUSABLE = -1e9
UNKNOWN_PENALTY = 10.0


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[list[tuple[str, float, int]], float, int]:
    """(piece, score, id) of the usable normal pieces, the score of an unknown character, the id of byte 0."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [(sp.id_to_piece(i), sp.get_score(i), i) for i in range(sp.get_piece_size())
              if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    least = min(s for _, s, _ in normal if s > UNUSABLE)
    pieces = [(p, max(s, least), i) for p, s, i in normal if s > UNUSABLE or p == BLANK]
    if any(BLANK in p[1:] or "\n" in p for p, _, _ in pieces):
        raise ValueError("a piece goes beyond a word, so words can't be taken one by one")
    if any(s != int(s) for _, s, _ in pieces):
        raise ValueError("scores must be whole numbers to be added exactly")
    return pieces, least - UNKNOWN_PENALTY, sp.piece_to_id("<0x00>")


@lru_cache(maxsize=2)
def winners(path: str) -> tuple[list[tuple[str, float, int]], float]:
    """The pieces that can be in a best path, and the score of an unknown character.

    A piece whose characters have a strictly better path without it is in none: that path could take its
    place in any other.  So it never ties either, and the best path to each end stays the same without such pieces.
    """
    pieces, unknown, _ = vocabulary(path)
    score, longest = {p: s for p, s, _ in pieces}, max(len(p) for p, _, _ in pieces)

    def without(piece: str) -> float:
        best = [0.0]
        for end in range(1, len(piece) + 1):
            ways = [best[end - 1] + score.get(piece[end - 1:end], unknown)]
            ways += [best[at] + score[piece[at:end]] for at in range(max(0, end - longest), end - 1) if piece[at:end] in score and end - at < len(piece)]
            best.append(max(ways))
        return best[-1]

    return [x for x in pieces if len(x[0]) == 1 or without(x[0]) <= x[1]], unknown


def library_model(path: str):
    """The library's own processor for this unigram model; tests compare with it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # unigram
    least = min(p.score for p in proto.pieces if p.type == 1 and p.score > UNUSABLE)
    for piece in proto.pieces:
        if piece.type == 1 and piece.score <= UNUSABLE:
            if piece.piece != BLANK:
                piece.type = 5  # unused
            piece.score = least
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
