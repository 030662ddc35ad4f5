import numpy as np
import pytest

from rankfold.llm import vectors


def brute(rows):
    good = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[n] = np.array(v, dtype=float) / np.linalg.norm(v)
    ids = sorted({i for i, _ in rows if i is not None})
    group, links = {i: i for i in ids}, {i: set() for i in ids}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n in good:
        for m in good:
            if n < m and len(good[n]) == len(good[m]) and rows[n][0] != rows[m][0] and good[n] @ good[m] >= 0.95:
                i, j = rows[n][0], rows[m][0]
                links[i].add(j)
                links[j].add(i)
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return sorted(((i, len(links[i]) if n in good else 0, find(i), find(i) == i) if i is not None else (None, 0, None, False)
                   for n, (i, _) in enumerate(rows)), key=str)


def cloud(seed, n, dim, centres, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dim))
    rows = [(int(i), [float(x) for x in base[rng.integers(centres)] + noise * rng.normal(size=dim)]) for i in range(n)]
    for i in range(0, n, 9):
        rows[i] = (i, list(rows[0][1]))  # copies
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cell string").repartition(3)


@pytest.mark.parametrize("noise", [0.1, 0.4])
def test_equals_brute_force(spark, monkeypatch, noise):
    monkeypatch.setattr(vectors, "HOME_BLOCK", 16)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 24)
    monkeypatch.setattr(vectors, "CELL", 20)
    rows = cloud(1, 260, 6, 12, noise)
    assert sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (None, [1.0, 0.0]),
            (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e300, 1e290]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-320, 0.0]), (-3, [1.0, 0.1])]
    assert sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows)).collect()), key=str) == brute(
        [(i, [1.0, 0.0] if i in (9, 12) else v) for i, v in rows])
    assert vectors.near_vectors(frame(spark, rows).limit(0)).count() == 0


def test_replicas_hold_every_near_pair():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(400, 3))
    u /= np.linalg.norm(u, axis=1)[:, None]
    home, inside = vectors.cells_of(u, u[:25], 0.2)
    for a, b in zip(*np.nonzero(np.linalg.norm(u[:, None] - u[None], axis=2) <= 0.2)):
        assert inside[b, home[a]]
    assert inside.mean() < 0.5


def unclustered(seed, n, dim=64):
    return np.random.default_rng(seed).normal(size=(n, dim))


def test_many_dimensions_equal_brute_force(spark, monkeypatch):
    """Vectors without clusters but for one large group of near copies; bounds by main axes, cells and blocks."""
    monkeypatch.setattr(vectors, "HOME_BLOCK", 40)
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    monkeypatch.setattr(vectors, "CELL", 70)
    monkeypatch.setattr(vectors, "CHUNK", (16, 24))
    v = unclustered(3, 300)
    v[40:110] = v[0] + 0.03 * v[40:110]
    v[200:220] = v[180:200] + 0.04 * v[200:220]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    assert sorted((tuple(r) for r in vectors.near_vectors(frame(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("dim", [3, 64])
def test_near_pairs_are_found_once(monkeypatch, dim):
    monkeypatch.setattr(vectors, "CHUNK", (32, 48))
    v = unclustered(4, 500, dim)
    v[::7] = v[0] + 0.05 * v[::7]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = np.triu(u @ u.T >= 0.95, 1)
    for left, right in ((np.arange(500), None), (np.arange(0, 500, 2), np.arange(1, 500, 2))):
        got = [tuple(sorted(p)) for a, b in vectors.near_pairs(u, left, right, 0.95) for p in zip(a.tolist(), b.tolist())]
        wanted = [(a, b) for a, b in zip(*np.nonzero(near)) if right is None or (a + b) % 2]
        assert len(wanted) > 1000 and sorted(got) == wanted


def test_exchanged_rows_grow_as_the_vectors(spark, monkeypatch):
    """Five times the vectors, without clusters: five times the rows that meet, and each vector is stored once."""
    kept, met = {}, {}
    store, meet = vectors.stored, vectors.meetings

    def spy(df, label):
        out = store(df, label)
        if label == "cells":
            kept[n] = out.count()
        return out

    def count(placed, n):
        out = meet(placed, n)
        met[n] = out[0].count()
        return out

    monkeypatch.setattr(vectors, "stored", spy)
    monkeypatch.setattr(vectors, "meetings", count)
    for n in (8192, 40960):
        ids = spark.range(n).selectExpr("id AS vec_id", "transform(sequence(0, 19), i -> (xxhash64(id, i) % 1000003) / 1000003D) AS embedding", "'x' AS cell")
        assert vectors.near_vectors(ids).count() == n
    assert kept == {8192: 8192, 40960: 40960}
    assert met[40960] <= 5 * met[8192] <= 5 * 8 * 8192


def test_trees_are_joined_at_their_smallest_node():
    root = vectors.bound_together(np.arange(8), np.array([7, 3, 5, 6]), np.array([3, 5, 1, 2]))
    assert root.tolist() == [0, 1, 2, 1, 4, 1, 2, 1]
    assert vectors.bound_together(root, np.array([2]), np.array([7])).tolist() == [0, 1, 1, 1, 4, 1, 1, 1]
