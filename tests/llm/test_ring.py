import zlib
from collections import Counter

import numpy as np
import pytest

from rankfold.functions.hashing import py_hash52
from rankfold.llm import ring

ROWS = [(i, f"t{i}") for i in range(500)] + [(None, "x")] * 300 + [(7, "t7")] * 30 + [(8, None), (8, ""), (9, "long " * 20000), (10, "é")]


def docs_with(docs_of, rows, parts=5):
    return docs_of(rows, parts).withColumnRenamed("length", "_at").withColumnRenamed("component_id", "_range")


@pytest.mark.parametrize("shards, slack", [(40, 0.0), (3, 0.0), (40, 0.25), (2000, 0.0)])
def test_bounds_slots_and_values(docs_of, shards, slack):
    got = ring.assign(docs_with(docs_of, ROWS), shards, points=16, slack=slack).collect()
    count = Counter(r.shard for r in got)
    counts = [count[s] for s in range(shards)]
    assert sum(counts) == len(ROWS) and set(count) <= set(range(shards))
    if slack:
        assert max(counts) <= np.ceil((1 + slack) * len(ROWS) / shards)
    else:
        assert max(counts) - min(counts) <= 1
    for s in count:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_overflow_equals_walking_key_by_key(docs_of):
    """Rows walk place by place; those that have come less far go first, along the ring among themselves."""
    shards, points, rows = 7, 5, [(i, f"t{i}") for i in range(400)]
    r = ring.make_ring(shards, points)
    room = ring.bounds(len(rows), shards, 0.0)
    at = sorted((py_hash52(ring.SEED, "key", i), i) for i, _ in rows)
    waiting, shard_of = [(h, i, int(np.searchsorted(r.places, h))) for h, i in at], {}
    for step in range(len(r.places)):
        rest = []
        for h, i, a in waiting:
            s = r.owner[(a + step) % len(r.places)]
            if room[s]:
                room[s] -= 1
                shard_of[i] = s
            else:
                rest.append((h, i, a))
        waiting = rest
    got = ring.assign(docs_of(rows), shards, points=points)
    assert {r.doc_id: r.shard for r in got.collect()} == shard_of


def test_growth_moves_few_rows(docs_of):
    docs = docs_of([(i, "t") for i in range(4000)])
    before, after = ring.assign(docs, 40, slack=0.25), ring.assign(docs, 41, slack=0.25)
    r = ring.moved(before, after).first()
    assert r["rows"] == 4000 and 0 < r["moved"] < 3 * 4000 / 41
    # the same with no bound in reach: rows move to the new shard only
    free = ring.assign(docs, 40, slack=50.0).select("doc_id", "shard").collect()
    grown = {r.doc_id: r.shard for r in ring.assign(docs, 41, slack=50.0).collect()}
    assert all(grown[r.doc_id] in (r.shard, 40) for r in free)


def test_empty_table_and_bad_slack(docs_of):
    assert ring.assign(docs_of([]), 40).collect() == []
    with pytest.raises(ValueError):
        ring.bounds(10, 4, -0.1)
