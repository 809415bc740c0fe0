"""Model queries cover all features, draws and rounds."""

import numpy as np
import pytest

from quarry.ml import models as M
from quarry.plans import models


@pytest.fixture(scope="module")
def data(spark, sf):
    got = models.rows(spark, sf).orderBy("row_id").collect()
    return np.array([r["features"] for r in got]), np.array([r["label"] for r in got])


def vector(df):
    return np.array([r["weight"] for r in sorted(df.collect(), key=lambda r: r["pos"])])


def test_gram_has_every_cell(spark, sf, data):
    x, _ = data
    got = {(r["i"], r["j"]): r["g"] for r in models.gram_matrix(spark, sf).collect()}
    want = x.T @ x
    assert len(got) == 64 * 64 and all(abs(v - want[k]) < 1e-4 for k, v in got.items())


def test_least_squares_is_solved(spark, sf, data):
    x, y = data
    assert np.allclose(vector(models.least_squares_model(spark, sf)), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_every_feature_is_dropped(spark, sf, data):
    x, y = data
    got = {int(r["candidate"]): r["loss"] for r in models.step_drop_features(spark, sf).collect()}
    assert set(got) == set(range(64))
    for f in (0, 40, 63):
        z, w = np.delete(x, f, 1), np.zeros(63)
        for _ in range(5):
            w = w - 0.0001 * z.T @ (z @ w - y)
        assert got[f] == pytest.approx(0.5 * ((z @ w - y) ** 2).mean(), abs=1e-7)


def test_draws_of_the_coreset(spark, sf, data):
    x, _ = data
    scores = np.einsum("ij,jk,ik->i", x, np.linalg.pinv(x.T @ x), x)
    assert abs(models.coreset_rows(spark, sf).count() - 200 * (scores.sum() - 1)) <= 1


def test_admm_runs_ten_rounds(spark, sf, data):
    x, y = data
    inv, z, u = np.linalg.pinv(x.T @ x), np.zeros(len(y)), np.zeros(len(y))
    for _ in range(10):
        w = inv @ (x.T @ (z - u))
        z = M.increasing_root(x @ w + u, y, 0.001)
        u = u + x @ w - z
    assert np.allclose(vector(models.admm_model(spark, sf)), w, atol=1e-6)
