import json
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rankfold.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(5)
    alphabet = [" ", "  ", "\n", "a", "the", "é", "1", "22", "'s", "!!", "\xa0", "　", "\t", "<|endoftext|>", "漢", "x", "\0", " \x1c", "\x85"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    return texts + [" ".join(rng.choice(alphabet[3:]) for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["\n".join("ab c" for _ in range(9))]


def test_encoder_equals_the_library_on_odd_spacing(monkeypatch):
    texts = odd_texts()
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.TextEncoder(f.read())
    monkeypatch.setattr(packing, "CHUNK", 50)
    assert [list(x) for x in encoder.encode(texts)] == library_ids(texts)
    assert list(encoder.encode([])) == []


def test_encoder_equals_the_library_on_the_vocabulary():
    t = Tokenizer.from_file(PATH)
    words = [t.decode([i]) for i in range(0, t.get_vocab_size(), 3)]
    texts = [w + x for w in words for x in ("", "s", " " + w)]
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.TextEncoder(f.read())
    assert [list(x) for x in encoder.encode(texts)] == library_ids(texts)


def test_other_tokenizers_encode_whole_texts():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert len(packing.byte_level_ranks(spec)) == 50256
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}},
                   {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"pre_tokenizer": None}):
        other = {**spec, **change}
        assert packing.byte_level_ranks(other) is None
        library = Tokenizer.from_str(json.dumps(other))
        library.encode_special_tokens = True
        texts = odd_texts()[::20] + ["The  THE the", " a"]
        want = [e.ids + [0] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [list(x) for x in packing.TextEncoder(json.dumps(other)).encode(texts)] == want
    assert packing.byte_level_ranks({**spec, "model": {**spec["model"], "merges": spec["model"]["merges"][::-1]}}) is None


def test_plan_uses_the_histogram_exactly_with_little_padding():
    rng = np.random.default_rng(3)
    hist = np.bincount(rng.integers(1, 129, 5000), minlength=129)
    plan = packing.plan_windows(hist, 128)
    got = np.zeros(129, dtype=int)
    for lengths, n in plan:
        assert sum(lengths) <= 128 and n > 0
        for v in lengths:
            got[v] += n
    assert (got == hist).all()
    assert sum(n * (128 - sum(v)) for v, n in plan) < 0.01 * sum(n * sum(v) for v, n in plan)
    assert {tuple(sorted(c[c > 0])) for c in packing.combinations(6, 3)} == {(6,), (1, 5), (2, 4), (3, 3), (1, 1, 4), (1, 2, 3), (2, 2, 2)}


def check(rows, texts, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert set(by_doc) == {i for i, _ in texts}
    for doc_id, own in by_doc.items():
        wanted = sorted(library_ids([t or "" for i, t in texts if i == doc_id]))
        pieces = sorted(((a, ids[a:a + window], len(ids)) for ids in wanted for a in range(0, len(ids), window)), key=str)
        assert sorted(((p[0], len(p[1]), zlib.crc32(np.array(p[1], dtype="<u4").tobytes()), p[2]) for p in pieces)) == \
            sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in own)


def test_pack_documents_odd_rows(docs_of, odd_rows):
    check(packing.pack_documents(docs_of(odd_rows), PATH, 64).collect(), odd_rows, 64)


def test_pack_documents_hot_length(docs_of):
    rng = random.Random(2)
    rows = [(i, "same length here" if i % 3 else " ".join("word" for _ in range(rng.randint(1, 90)))) for i in range(600)]
    out = packing.pack_documents(docs_of(rows), PATH, 64)
    check(out.collect(), rows, 64)
    r = packing.padding(out, 64).collect()[0]
    assert r.padding < 0.02 * r.tokens


def test_keep_ids_and_empty_table(docs_of, spark):
    rows = packing.pack_documents(docs_of([(1, "a b c")]), PATH, 64, keep_ids=True).collect()
    assert [list(r.ids) for r in rows] == library_ids(["a b c"])
    assert packing.pack_documents(docs_of([(1, "x")]).limit(0), PATH, 64).count() == 0
