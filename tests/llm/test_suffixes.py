import random

from rankfold.llm import suffixes


def brute(rows, m):
    """Spans from all windows of all distinct (id, words)."""
    docs = sorted({(i, tuple((t or "").encode().split())) for i, t in rows if i is not None})
    places = {}
    for n, (i, w) in enumerate(docs):
        for a in range(len(w) - m + 1):
            places.setdefault(w[a:a + m], []).append((i, n, a))
    out = set()
    for n, (i, w) in enumerate(docs):
        seen, gone, source = [False] * len(w), [False] * len(w), {}
        for a in range(len(w) - m + 1):
            own = places[w[a:a + m]]
            if len(own) > 1:
                later = own[0] != (i, n, a)
                if later:
                    source[a] = own[0][0]
                for k in range(a, a + m):
                    (gone if later else seen)[k] = True
        for kind, cover in ((False, [s and not g for s, g in zip(seen, gone)]), (True, gone)):
            a = 0
            while a < len(w):
                b = a
                while b < len(w) and cover[b]:
                    b += 1
                if b > a:
                    same = min(j for j, v in docs if v == w)  # a whole copy names its original
                    out.add((i, a, b, kind, i if not kind else same if same < i else source[a]))
                a = b + 1
    return out


def corpus(rng, n=120):
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(10, 45))] for _ in range(5)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(1, 5)):
            w += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.1 and rows:
            w = rng.choice(rows)[1].split()
        rows.append((i, " ".join(w)))
    return rows + [(n, "again " * 40), (n + 1, "x " + "again " * 30), (n + 2, "a b c " * 20)]


def test_equals_brute_force(docs_of):
    rows = corpus(random.Random(3))
    got = suffixes.repeated_passages(docs_of(rows), min_words=12, gram=4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 12)


def test_odd_rows(docs_of, odd_rows):
    rows = odd_rows + [(20, " ".join(f"x{i}" for i in range(60))), (21, "before " + " ".join(f"x{i}" for i in range(60)))]
    got = suffixes.repeated_passages(docs_of(rows)).collect()
    assert {tuple(r) for r in got} == brute(rows, 50)
    assert (21, 1, 61, True, 20) in {tuple(r) for r in got}
    assert suffixes.repeated_passages(docs_of(rows).limit(0)).count() == 0


def test_drop_repeats_leaves_one_place_and_all_rows(docs_of):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(rng.randint(0, 20))) + "\n" + passage + f" tail{i}") for i in range(30)] + [(99, None), (98, "clean  text\n")]
    out = {r.doc_id: r for r in suffixes.drop_repeats(docs_of(rows)).collect()}
    assert set(out) == {i for i, _ in rows} and out[99].text is None and out[98].text == "clean  text\n"
    assert [i for i in out if out[i].text and passage in out[i].text] == [0]
    assert all(out[i].text.endswith(f" tail{i}") and out[i].text.startswith(rows[i][1].split("\n")[0]) for i in range(1, 30))
    assert out[5].component_id is None and out[5].length == "x"


def test_cut_words():
    assert suffixes.cut_words("a b\tc  d e", [(1, 3)]) == "a  d e"
    assert suffixes.cut_words("a b", [(0, 2)]) == "" and suffixes.cut_words(None, [(0, 1)]) is None
