"""`wals` is the whole loop: the rank its samples are drawn for and the reference's ten rounds."""

import duckdb
import numpy as np

import __spark_entry__ as E

from rankfold.operators import factorize as FZ
from rankfold.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_wals_of_the_samples_rank_and_ten_rounds_matches_sql(spark, monkeypatch):
    asked, wals = [], FZ.wals
    monkeypatch.setattr(R.FZ, "wals", lambda o, ids, rank, iters, *a: asked.append((rank, iters)) or wals(o, ids, rank, iters, *a))
    got = {(r["side"], r["id"], r["k"]): r["val"] for r in E.queries()["wals"](spark, SF).collect()}
    assert asked == [(R.RANK, 10)] and {k for _, _, k in got} == {0, 1}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{SF}/lineitem.parquet')")
    want = {tuple(r[:3]): r[3] for r in con.execute(E.oracle_sql()["wals"]).fetchall()}
    assert got.keys() == want.keys()
    keys = sorted(want)
    assert np.allclose([got[k] for k in keys], [want[k] for k in keys], rtol=1e-8, atol=1e-7)


def test_the_sql_half_step_is_least_norm_where_singular():
    con = duckdb.connect()
    cells = [(1, 1, 2.0), (2, 1, 1.0), (2, 2, 3.0), (2, 3, -1.0), (3, 4, 5.0)]  # one sample, three, and one on a zero factor
    v = {1: (1.0, 2.0), 2: (0.5, -1.0), 3: (2.0, 0.0), 4: (0.0, 0.0)}
    con.execute("CREATE TABLE observed AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {x}::DOUBLE, 1.0::DOUBLE)" for i, j, x in cells) + ") t(i, j, val, w)")
    con.execute("CREATE TABLE src AS SELECT * FROM (VALUES " + ", ".join(f"({j}, {a}::DOUBLE, {b}::DOUBLE)" for j, (a, b) in v.items()) + ") t(id, f0, f1)")
    got = {r[0]: r[1:] for r in con.execute("WITH " + R.sql_half2("u", "src", "i", "j") + " SELECT id, f0, f1 FROM u").fetchall()}
    for i in (1, 2, 3):
        a = np.array([v[j] for k, j, _ in cells if k == i])
        want = np.linalg.pinv(a) @ [x for k, _, x in cells if k == i]
        assert np.allclose(got[i], want, atol=1e-12)
