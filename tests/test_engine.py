"""Access methods of the epoch engine, sparse training and merged replicas against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.ml import engine, models

RNG = np.random.default_rng(3)
X = np.round(RNG.normal(size=(90, 5)), 3)
X[::4, 2] = 0
Y = (X @ np.array([1.0, -2.0, 0.5, 0.0, 1.5]) > 0).astype(float)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, x.tolist(), float(y)) for i, (x, y) in enumerate(zip(X, Y))], "row_id long, features array<double>, label double")


def sigmoid(d):
    return 1 / (1 + np.exp(-d))


def gradient(w):
    return X.T @ (sigmoid(X @ w) - Y)


@pytest.mark.parametrize("stored", ["files", "cache"])
def test_access_methods_agree(spark, table, stored, monkeypatch):
    if stored == "cache":
        monkeypatch.setattr(engine, "_openable", lambda root: False)
    monkeypatch.setattr(engine, "PIECE_BYTES", 8 * 5 * 7)
    w = np.linspace(-1, 1, 5)
    e = engine.Engine(table, 5, partitions=3)
    handles = [e.register_row(models.logistic), e.register_column(models.logistic_column), e.register_c2r(lambda j, x, rows, y, w: float(x @ (sigmoid(rows @ w) - y)))]
    for h in handles:
        _, new = e.exec(h, w, 0.1)
        assert np.allclose(new, w - 0.1 * gradient(w))
    assert e.exec(handles[0], w)[0] == pytest.approx(float((np.logaddexp(0, X @ w) - Y * (X @ w)).sum()))
    e.close()


def folded(parts, w, rate):
    out = []
    for at in parts:
        m = w.copy()
        for x, y in zip(X[at], Y[at]):
            m -= rate * (sigmoid(x @ m) - y) * x
        out.append((m, len(at)))
    return out


def test_one_partition_is_the_sequential_fold(spark, table):
    e = engine.Engine(table, 5, partitions=1)
    _, got = e.exec(e.register_update(models.logistic_sgd(0.05)), np.zeros(5))
    e.close()
    assert np.allclose(got, folded([range(90)], np.zeros(5), 0.05)[0][0])


def test_replicas_merge_by_a_function(spark, table):
    e = engine.Engine(table, 5, partitions=4)
    h = e.register_update(models.logistic_sgd(0.05))
    _, mean = e.exec(h, np.zeros(5))
    e.register_model_avg(lambda a, n, b, k: (a * n + b * k) / (n + k))
    _, same = e.exec(h, np.zeros(5))
    e.register_model_avg(lambda a, n, b, k: np.maximum(a, b))
    _, top = e.exec(h, np.zeros(5))
    e.close()
    assert np.allclose(mean, same) and (top >= mean - 1e-12).all() and not np.allclose(top, mean)


def test_sparse_rows_train_like_dense_ones(spark, table):
    sparse = table.select("row_id", F.expr("filter(sequence(0, 4), j -> get(features, j) <> 0)").alias("idx"), F.expr("filter(features, x -> x <> 0)").alias("val"), "label")
    got = models.fit_sparse(sparse, 5, epochs=2, rate=0.05, partitions=1)
    w = np.zeros(5)
    for _ in range(2):
        w = folded([range(90)], w, 0.05)[0][0]
    assert np.allclose(got.model, w) and got.losses[0] == pytest.approx(np.log(2)) and got.losses[1] < got.losses[0]
    assert models.fit_sparse(sparse.limit(0), 5, epochs=1).model.tolist() == [0.0] * 5


def test_libsvm_file_to_model(spark, tmp_path):
    from quarry.sources import files

    text = "\n".join(f"{'+1' if y else '-1'} " + " ".join(f"{j + 1}:{v}" for j, v in enumerate(x) if v) for x, y in zip(X, Y))
    (tmp_path / "a.txt").write_text(text + "\n")
    fit = models.train_libsvm(spark, str(tmp_path / "a.txt"), 6, str(tmp_path / "model"), epochs=5, rate=0.1, partitions=1)
    assert fit.losses[-1] < 0.6 * fit.losses[0]
    assert np.allclose(files.read_model(spark, str(tmp_path / "model")), fit.model)


def test_wrong_rows_are_an_error(spark):
    bad = spark.createDataFrame([(0, [1.0], 1.0)], "row_id long, features array<double>, label double")
    with pytest.raises(Exception, match="needs 5 features"):
        engine.Engine(bad, 5)
