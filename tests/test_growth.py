"""One-pass sketches that grow until their values can be told from the estimator's spread."""

import math

import numpy as np
import pytest

from rankfold.operators import sketch as K
from rankfold.plans import jobs

from matrices import dense_cells


def test_appended_coordinates_equal_one_sketch(spark):
    rng = np.random.default_rng(2)
    cells = dense_cells(spark, rng.normal(size=(50, 4)).tolist(), rng.normal(size=(50, 3)).tolist())
    coords = K.pick_coords(5, 64, 21)
    assert coords[:6] == K.pick_coords(5, 64, 6)
    grown = K.append_coords(K.srht_sketch_wide(cells, coords[:6], 5, 64), cells, coords, 6, 5, 64)
    whole = {(r["mat"], r["col"]): (r["sk"], r["norm2"]) for r in K.srht_sketch_wide(cells, coords, 5, 64).collect()}
    got = {(r["mat"], r["col"]): (r["sk"], r["norm2"]) for r in grown.collect()}
    assert got.keys() == whole.keys()
    for key, (sk, norm2) in whole.items():
        assert np.allclose(got[key][0], sk, atol=1e-12) and math.isclose(got[key][1], norm2, rel_tol=1e-12)


def test_sizes():
    error = lambda value, spread: [("value_rms", 0, value), ("estimator_spread", 0, spread)]
    assert jobs.next_size(error(math.hypot(10, 1), 1), 64, 0.1, 9999) is None  # just enough
    assert jobs.next_size(error(math.hypot(10, 4), 4), 64, 0.1, 9999) == 1024  # (4 / (0.1 * 10))**2 times 64
    assert jobs.next_size(error(math.hypot(10, 1.1), 1.1), 64, 0.1, 9999) == 128  # at least twice
    assert jobs.next_size(error(14645.0, 14643.0), 64, 0.5, 9999) == 256  # nothing but spread
    assert jobs.next_size(error(0.0, 0.0), 64, 0.5, 9999) is None  # all columns are zero
    assert jobs.next_size(error(14645.0, 14643.0), 64, 0.5, 100) == 100
    with pytest.raises(ValueError, match="two_pass"):
        jobs.next_size(error(14645.0, 14643.0), 100, 0.5, 100)


def _aligned(spark):
    """A and B share one strong direction, so that values are near the product of the norms."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 1))
    a = x @ rng.uniform(1, 2, size=(1, 12)) + 0.1 * rng.normal(size=(100, 12))
    b = x @ rng.uniform(1, 2, size=(1, 10)) + 0.1 * rng.normal(size=(100, 10))
    return dense_cells(spark, a.tolist(), b.tolist())


def test_the_sketch_grows_as_far_as_needed(spark):
    got = jobs.one_pass_factorize(spark, _aligned(spark), rank=1, k=4, iters=6, ss=6.0, seed=3, estimator="raw", n_rows=100, share=0.3)
    rep = {r["metric"]: r["value"] for r in got["report"].collect() if r["round"] == 0}
    assert 8 <= rep["k"] <= 63 and rep["rel_error"] < 0.6
    assert rep["estimator_spread"] <= 0.3 * math.sqrt(rep["value_rms"] ** 2 - rep["estimator_spread"] ** 2)
    assert got["sketch"].first()["sk"] is not None and len(got["sketch"].first()["sk"]) == rep["k"]


def test_noise_is_an_error_or_a_warning(spark):
    rng = np.random.default_rng(6)
    basis = np.linalg.qr(rng.normal(size=(128, 14)))[0]  # orthogonal columns: every value is 0
    cells = dense_cells(spark, basis[:, :8].tolist(), basis[:, 8:].tolist())
    with pytest.raises(ValueError, match="two_pass"):
        jobs.one_pass_factorize(spark, cells, rank=1, k=4, iters=2, seed=3, n_rows=128, share=0.3, k_max=16)
    with pytest.warns(UserWarning, match="noise"):
        jobs.one_pass_factorize(spark, cells, rank=1, k=8, iters=2, seed=3, n_rows=128, evaluate=False)
    with pytest.raises(ValueError, match="share"):
        jobs.one_pass_factorize(spark, cells, sketch="gaussian", share=0.3)
