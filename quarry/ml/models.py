"""Generalised linear models, linear SVM, perceptron and ADMM on the epoch engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.ml.engine import Engine, _vector
from quarry.ml.select import gram
from quarry.session import Scratch


def _sigmoid(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -700, 700)))


def logistic(x, y, w):
    d = x @ w
    return float((np.logaddexp(0, d) - y * d).sum()), x.T @ (_sigmoid(d) - y)


def least_squares(x, y, w):
    e = x @ w - y
    return 0.5 * float(e @ e), x.T @ e


def perceptron(x, y, w):
    """The value is the signed sum of .6 (y - prediction), as each row's step."""
    step = 0.6 * (y - (x @ w >= 0))
    return float(step.sum()), -(x.T @ step)


def svm(x, y, w, penalty: float = 0.2):
    """Hinge loss plus half the penalty times the squared norm, per row; labels -1 and +1."""
    m = 1 - y * (x @ w)
    hit = m > 0
    return float(m[hit].sum()) + 0.5 * penalty * float(w @ w) * len(y), -(x[hit].T @ y[hit]) + penalty * w * len(y)


def _sequential(residual: Callable[[float, float], float], rate: float, shrink: float = 0.0):
    """SGD in row order with immediate updates; ``shrink`` divides touched weights by 1 + shrink."""

    def fold(x, y, w):
        w = w.copy()
        for xi, yi in zip(x, y):
            w -= rate * residual(float(xi @ w), yi) * xi
            if shrink:
                w[xi != 0] /= 1 + shrink
        return w

    return fold


def logistic_sgd(rate: float = 1e-5, shrink: float = 0.0):
    return _sequential(lambda d, y: float(_sigmoid(np.float64(d))) - y, rate, shrink)


def least_squares_sgd(rate: float = 0.001):
    return _sequential(lambda d, y: d - y, rate)


def perceptron_sgd(rate: float = 0.6):
    return _sequential(lambda d, y: float(d >= 0) - y, rate)


def svm_sgd(rate: float = 0.001, penalty: float = 0.2):
    def fold(x, y, w):
        w = w.copy()
        for xi, yi in zip(x, y):
            g = penalty * w - (yi * xi if yi * float(xi @ w) < 1 else 0)
            w -= rate * g
        return w

    return fold


def logistic_column(j, x, d, y, w):
    """Coordinate gradient of the logistic loss."""
    return float(x @ (_sigmoid(d) - y))


def logistic_column_compat(j, x, d, y, w):
    """The variant with y in the pattern term: -sum(y x) + sum(y x e^{y d} / (1 + e^d))."""
    return float(-(y * x).sum() + (y * x * np.exp(np.clip(y * d, -700, 700)) / (1 + np.exp(np.clip(d, -700, 700)))).sum())


@dataclass
class Fit:
    model: np.ndarray
    losses: list[float]


BATCH = {"logistic": (logistic, 0.001), "least_squares": (least_squares, 0.001), "perceptron": (perceptron, 1.0), "svm": (svm, 0.001)}
FOLDS = {"logistic": logistic_sgd, "least_squares": least_squares_sgd, "perceptron": perceptron_sgd, "svm": svm_sgd}


def fit(rows: DataFrame, width: int, kind: str, epochs: int = 10, rate: float | None = None, access: str = "row", partitions: int | None = None, model: np.ndarray | None = None, mean_gradient: bool = True) -> Fit:
    """Trains one model: ``access`` is row (mini-batch gradient), fold (SGD per partition, averaged) or
    column (coordinate gradients). Losses are means before each epoch's update."""
    loss, default = BATCH[kind]
    rate = default if rate is None else rate
    w = np.zeros(width) if model is None else np.asarray(model, np.float64)
    engine = Engine(rows, width, partitions)
    h_loss = engine.register_row(loss)
    h_fold = engine.register_update(FOLDS[kind](rate)) if access == "fold" else -1
    h_col = engine.register_column(logistic_column) if access == "column" else -1
    losses = []
    try:
        n = engine._sums(lambda x, y: (0.0, None))[2]
        for _ in range(epochs):
            step = rate / max(n, 1) if mean_gradient else rate
            total, new = engine.exec(h_loss, w, step)
            losses.append(total / max(n, 1))
            if access == "fold":
                _, new = engine.exec(h_fold, w)
            elif access == "column":
                _, new = engine.exec(h_col, w, step)
            w = new
    finally:
        engine.close()
    return Fit(w, losses)


def fit_sparse(rows: DataFrame, width: int, epochs: int = 10, rate: float = 0.01, shrink: float = 0.0, partitions: int | None = None, model: np.ndarray | None = None) -> Fit:
    """Logistic regression by SGD over sparse rows ``row_id, idx, val, label`` (label above 0 is positive).

    Each partition folds its rows in row order from the same model, touching only a row's own weights
    (``shrink`` divides them by 1 + shrink); the partitions' models are averaged by rows. Losses are
    means before each epoch. Rows with a null label are an error; indices must lie below ``width``.
    """
    src = rows.select("row_id", "idx", "val", (F.col("label") > 0).cast("double").alias("label"))
    if partitions:
        src = src.repartitionByRange(partitions, "row_id")
    scratch = Scratch(rows.sparkSession, "sparse")
    src = scratch.write(src.sortWithinPartitions("row_id"))
    w = np.zeros(width) if model is None else np.asarray(model, np.float64)
    losses = []
    for _ in range(epochs):

        def run(batches, start=w):
            m, n, loss = start.copy(), 0, 0.0
            for b in batches:
                idx, val = (b.column(c).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c) for c in ("idx", "val"))
                offset = np.asarray(idx.offsets) - idx.offsets[0].as_py()
                at, x = np.asarray(idx.flatten()), np.asarray(val.flatten(), np.float64)
                if b.column("label").null_count:
                    raise ValueError("every row needs a label")
                for k, y in enumerate(b.column("label").to_numpy()):
                    i, v = at[offset[k] : offset[k + 1]], x[offset[k] : offset[k + 1]]
                    d0, d = float(v @ start[i]), float(v @ m[i])
                    loss += float(np.logaddexp(0, d0) - y * d0)
                    np.subtract.at(m, i, rate * (float(_sigmoid(np.float64(d))) - y) * v)
                    if shrink:
                        m[np.unique(i)] /= 1 + shrink
                    n += 1
            yield from _vector(m * n, loss, n)

        got = src.select("idx", "val", "label").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(width + 2)
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        n = out[width + 1]
        losses.append(out[width] / max(n, 1))
        w = out[:width] / n if n else w
    scratch.clear()
    return Fit(w, losses)


def train_libsvm(spark, path: str, width: int, model_path: str | None = None, **options) -> Fit:
    """Trains ``fit_sparse`` on a LIBSVM file and writes the model if a path is given."""
    from quarry.sources import files

    done = fit_sparse(files.read_libsvm(spark, path), width, **options)
    if model_path:
        files.write_model(spark, done.model.tolist(), model_path)
    return done


def predict(rows: DataFrame, model: np.ndarray, low: float = -1.0) -> DataFrame:
    """Adds ``score``, ``probability`` and ``prediction`` (1 above one half, else ``low``)."""
    w = F.array(*[F.lit(float(x)) for x in model])
    d = scalars.dot(F.col("features"), w)
    p = scalars.sigmoid(F.col("score"))
    return rows.withColumn("score", d).withColumn("probability", p).withColumn("prediction", F.when(F.col("probability") > 0.5, 1.0).otherwise(low))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.abs(F.col("prediction") - F.col("label")) < 1e-5).cast("double")).alias("accuracy"))


def mean_loss(rows: DataFrame, model: np.ndarray, loss: Callable[[Column, Column], Column]) -> DataFrame:
    """Mean of a column-expression loss, all inside the JVM."""
    w = F.array(*[F.lit(float(x)) for x in model])
    return rows.agg(F.avg(loss(scalars.dot(F.col("features"), w), F.col("label"))).alias("loss"))


def two_models(rows: DataFrame, width: int, epochs: int = 5, rate: float = 0.001) -> tuple[np.ndarray, np.ndarray]:
    """Two logistic models over rows with ``label`` and ``label2`` in the same passes."""
    pair = rows.withColumn("features", F.concat("features", F.array(F.col("label2").cast("double"))))
    engine = Engine(pair, width + 1)

    def both(x, y, w):
        a, b = w[:width], w[width : 2 * width]
        la, ga = logistic(x[:, :width], y, a)
        lb, gb = logistic(x[:, :width], x[:, width], b)
        return la + lb, np.concatenate([ga, gb])

    engine.width = width + 1
    w = np.zeros(2 * width)
    h = engine.register_row(both)
    kind, f = engine._functions[h]
    try:
        for _ in range(epochs):
            w = w - rate * _wide_gradient(engine, f, w)
    finally:
        engine.close()
    return w[:width], w[width:]


def _wide_gradient(engine: Engine, f: Callable, w: np.ndarray) -> np.ndarray:
    """Gradient of a function whose model is wider than its rows."""
    from quarry.ml.engine import unpack_blocks

    width = engine.width

    def run(batches):
        g = np.zeros(len(w))
        for x, y in unpack_blocks(batches, width):
            g += f(x, y, w)[1]
        yield pa.record_batch([pa.array(np.arange(len(w))), pa.array(g)], names=["i", "v"])

    got = engine.blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(w))
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def increasing_root(c: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """p with -y + 1/(1 + e^-p) + penalty (p - c) = 0, for every row at once.

    The left side increases in p; brackets double until the sign changes, then halve.
    """
    f = lambda p: -y + _sigmoid(p) + penalty * (p - c)
    lo, hi = np.full(len(c), -10.0), np.full(len(c), 10.0)
    while (bad := f(lo) > 0).any():
        lo[bad] *= 2
    while (bad := f(hi) < 0).any():
        hi[bad] *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        up = f(mid) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def admm(rows: DataFrame, width: int, rounds: int = 10, penalty: float = 0.001, qr: bool = False) -> np.ndarray:
    """Logistic regression by ADMM: x solves least squares against z - u, z a root per row, u their gap.

    The rows' z and u live in a table that each round writes anew; the driver holds X'X (or its
    Cholesky factor, the R of a QR decomposition) and one vector.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "admm")
    g = gram(rows, width)
    if qr:
        r = np.linalg.cholesky(g + 1e-12 * np.trace(g) / width * np.eye(width)).T
        solve = lambda v: np.linalg.solve(r, np.linalg.solve(r.T, v))
    else:
        inv = np.linalg.pinv(g)
        solve = lambda v: inv @ v
    cur = scratch.write(rows.select("features", F.col("label").cast("double"), F.lit(0.0).alias("z"), F.lit(0.0).alias("u")))
    x = np.zeros(width)
    for _ in range(rounds):
        x = solve(_weighted_sum(cur, width))

        def step(batches, x=x):
            for b in batches:
                a = np.asarray(b.column(0).flatten()).reshape(-1, width)
                y, u = b.column(1).to_numpy(), b.column(3).to_numpy()
                ax = a @ x
                z = increasing_root(ax + u, y, penalty)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(z), pa.array(u + ax - z)], names=["features", "label", "z", "u"])

        new = scratch.write(cur.mapInArrow(step, "features array<double>, label double, z double, u double"))
        scratch.drop(cur)
        cur = new
    return x


def _weighted_sum(cur: DataFrame, width: int) -> np.ndarray:
    """X' (z - u)."""

    def run(batches):
        s = np.zeros(width)
        for b in batches:
            s += np.asarray(b.column(0).flatten()).reshape(-1, width).T @ (b.column(2).to_numpy() - b.column(3).to_numpy())
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(s)], names=["i", "v"])

    got = cur.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(width)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out
