import random

import corpus_pipeline
from rankfold.llm import minhash


def write(spark, path, rows, labels):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    def words(n):
        return ["".join(rng.choices("abcdefgilmnorst", k=rng.randint(3, 9))) for _ in range(n)]
    rows, labels, passage = [], [], words(60)
    for i in range(240):
        w = words(rng.randint(30, 90))
        toxic = int(i % 4 == 0)
        for _ in range(6 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["stupid", "moron", "loser"]))
        if i in (21, 22, 23):
            w = w[:40] + passage
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    near = rows[5][1].split()
    near[3] = "changed"
    rows += [(300, " ".join(near)), (301, rows[6][1]), (302, rows[7][1] + " password = hunter2hunter2"), (303, None), (304, ""), (305, " ".join(passage))]
    docs = write(spark, str(tmp_path), rows, labels)
    seen, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, str(tmp_path))
        if name != "packing":
            assert after.dtypes == docs.dtypes
        after.write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in before.collect()}
    kept = set(seen["toxicity"])
    clean = {i for i, _, y in labels if not y}
    assert len(clean - kept) <= 0.05 * len(clean) and len([i for i, _, y in labels if y and i in kept]) <= 6 and {303, 304} <= kept
    wanted = {r.doc_id for r in minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/toxicity")).where("kept").collect()}
    assert set(seen["near_dedup"]) == wanted and not {301} & wanted and len({5, 300} & wanted) == 1
    cut = seen["passage_dedup"]
    assert sum(" ".join(passage) in (r.text or "") for r in cut.values()) == 1 and 305 not in cut
    assert all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)
    assert set(cut) == set(seen["near_dedup"]) - {305}
    assert set(seen["secret_scan"]) == set(cut) and not any("hunter2" in (r.text or "") for r in seen["secret_scan"].values())
    assert set(seen["packing"]) == set(cut)
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(spark.read.parquet(f"{tmp_path}/packing").collect())


def test_near_dedup_stage_takes_copies_from_080_on(spark, tmp_path):
    from test_minhash import brute
    rng = random.Random(8)
    rows = []
    for i, (n, changed) in enumerate([(1000, 17), (1000, 19), (1000, 24), (300, 5), (300, 8), (100, 2), (100, 3)]):
        w = ["".join(rng.choices("abcdefgilmnorst", k=8)) for _ in range(n)]
        copy = list(w)
        for k in range(changed):
            copy[(k + 1) * n // (changed + 1)] = f"changed{k}"
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(copy))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, str(tmp_path)).collect()}
    wanted = {i for i, _, _, kept in brute(rows, 80) if kept}
    assert got == wanted and wanted < {i for i, _, _, kept in brute(rows, 85) if kept}


def test_stages_keep_columns_with_names_of_their_own(spark, tmp_path):
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(10 ** 6)}" for _ in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30)) + (" " + passage if i < 2 else "")) for i in range(8)]
    rows += [(20, rows[3][1]), (None, rows[4][1]), (None, None), (21, "")]
    names = ["_gone", "_gone_", "_key", "_SPANS", "_words", "cls", "kept"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        assert after.columns == docs.columns
        docs = after
    got = docs.collect()
    assert all(tuple(r[n] for n in names) == tuple(names) for r in got)
    assert sorted(str(r.doc_id) for r in got) == sorted(["0", "1", "2", "3", "4", "5", "6", "7", "None", "None", "21"])
    assert sum(passage in (r.text or "") for r in got) == 1
