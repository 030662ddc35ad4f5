"""Registered queries against their DuckDB twins on the smallest tables
(the full sweep is scripts/check_oracle.py)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["supplier", "nation", "part", "lineitem", "embeddings", "events"]
FAST = ["col_norms", "product_exact", "hadamard_vectors", "pick_coords", "srht_sketch_cells",
        "sample_adaptive", "value_exact", "value_rescaled", "apply_product", "decay_matrix"]


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda k: cols[k])

    def norm(v):
        if isinstance(v, float):
            return 0.0 if v == 0 else float(f"{v:.9g}") if not math.isnan(v) else "nan"
        return v
    return sorted(tuple(norm(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(res.fetchall(), ocols)
