"""Model, scaling and clustering queries on the embeddings and points."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.ml import engine, models, select
from quarry.session import Scratch, load
from quarry.streaming import kmedian

WIDTH = 64


def rows(spark, d, plus_minus: bool = False) -> DataFrame:
    """Embeddings as rows; the label is its parity, 0/1 or -1/+1."""
    y = (F.col("label") % 2).cast("double")
    return load(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), (2 * y - 1 if plus_minus else y).alias("label"))


def weights() -> np.ndarray:
    return np.array([((j * 37) % 19 - 9) / 100 for j in range(WIDTH)])


def _loss(spark, d, f, plus_minus=False):
    return models.mean_loss(rows(spark, d, plus_minus), weights(), f).select(F.round("loss", 8).alias("loss"))


def glm_loss(spark, d):
    return _loss(spark, d, scalars.log_loss)


def ls_loss(spark, d):
    return _loss(spark, d, scalars.squared_loss)


def svm_loss(spark, d):
    reg = 0.1 * float((weights() ** 2).sum())
    return _loss(spark, d, lambda s, y: scalars.hinge_loss(s, y) + reg, True)


def perceptron_loss(spark, d):
    return _loss(spark, d, lambda s, y: 0.6 * (y - F.when(s >= 0, 1.0).otherwise(0.0)))


def _vector_frame(spark, v, name="weight"):
    return spark.createDataFrame([(i, round(float(x), 8)) for i, x in enumerate(v)], f"pos int, {name} double")


def glm_grad_epoch(spark, d):
    """One full-gradient step of logistic regression on the engine."""
    e = engine.Engine(rows(spark, d), WIDTH)
    try:
        return _vector_frame(spark, e.exec(e.register_row(models.logistic), weights(), 0.001)[1])
    finally:
        e.close()


def glm_column_epoch(spark, d):
    """The same step by column access."""
    e = engine.Engine(rows(spark, d), WIDTH)
    try:
        return _vector_frame(spark, e.exec(e.register_column(models.logistic_column), weights(), 0.001)[1])
    finally:
        e.close()


def glm_column_to_row_epoch(spark, d):
    """The same step by column-to-row access."""
    e = engine.Engine(rows(spark, d), WIDTH)
    try:
        step = lambda j, x, rows, y, w: float(x @ (models._sigmoid(rows @ w) - y))
        return _vector_frame(spark, e.exec(e.register_c2r(step), weights(), 0.001)[1])
    finally:
        e.close()


def glm_sparse_gradient(spark, d):
    """Gradient of sparse rows by joins on the feature."""
    r = rows(spark, d)
    sparse = r.select("row_id", F.sequence(F.lit(0), F.lit(WIDTH - 1)).alias("idx"), F.col("features").alias("val"), "label")
    m = spark.createDataFrame([(i, float(x)) for i, x in enumerate(weights())], "col int, w double")
    return engine.sparse_gradient(sparse, m, lambda s, y: scalars.sigmoid(s) - y).select("col", F.round("g", 6).alias("g"))


def glm_accuracy(spark, d):
    p = models.predict(rows(spark, d), weights(), low=0.0)
    return models.accuracy(p).select(F.round("accuracy", 9).alias("accuracy"))


def glm_predictions(spark, d):
    return models.predict(rows(spark, d, True), weights()).select("row_id", "prediction")


def glm_train(spark, d):
    """Losses of ten epochs of logistic regression."""
    return _losses(spark, models.fit(rows(spark, d), WIDTH, "logistic", 10, 0.1))


def _losses(spark, fit: models.Fit) -> DataFrame:
    return spark.createDataFrame([(k, round(float(x), 8)) for k, x in enumerate(fit.losses)], "epoch int, loss double")


def glm_sparse_train(spark, d):
    """Losses of SGD over sparse rows, in row order within four partitions."""
    r = rows(spark, d)
    sparse = r.select("row_id", F.sequence(F.lit(0), F.lit(WIDTH - 1)).alias("idx"), F.col("features").alias("val"), "label")
    return _losses(spark, models.fit_sparse(sparse, WIDTH, 3, 0.01, partitions=4))


def svm_train(spark, d):
    return _losses(spark, models.fit(rows(spark, d, True), WIDTH, "svm", 10, 0.05))


def glm_fold_train(spark, d):
    """SGD per partition in row order, models averaged after every epoch."""
    f = models.fit(rows(spark, d), WIDTH, "logistic", 3, 0.01, access="fold", partitions=4)
    return spark.createDataFrame(list(enumerate(map(float, f.losses))), "epoch int, loss double")


def admm_model(spark, d):
    return _vector_frame(spark, models.admm(rows(spark, d), WIDTH))


def gram_matrix(spark, d):
    """All cells of the Gram matrix."""
    g = select.gram(rows(spark, d), WIDTH)
    return spark.createDataFrame([(i, j, round(float(g[i, j]), 5)) for i in range(WIDTH) for j in range(WIDTH)], "i int, j int, g double")


def least_squares_model(spark, d):
    """The solved least-squares model over all features."""
    return _vector_frame(spark, select.least_squares(rows(spark, d), WIDTH))


def step_drop_features(spark, d):
    """Losses without each of the features."""
    base = list(range(WIDTH))
    t = select.step_search(rows(spark, d), {str(f): select.remove_columns(base, [f]) for f in base}, rate=0.0001)
    return t.select("candidate", F.round("loss", 8).alias("loss"))


def coreset_rows(spark, d):
    """A leverage-weighted sample with repetition."""
    return select.coreset(rows(spark, d), WIDTH).select("draw", "row_id")


def minmax_scale(spark, d):
    s = select.min_max(load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")), ["size", "price"])
    return s.select("p_partkey", F.round("size", 9).alias("size"), F.round("price", 9).alias("price"), "intercept")


def transpose_columns(spark, d):
    """Column store of the embeddings summed per column."""
    return select.transpose(rows(spark, d)).groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 5).alias("total"))


def _points(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), F.lit(1.0).alias("weight"), F.col("embedding").alias("coord"))


def _first_centres(spark, d):
    return np.array([r["coord"] for r in _points(spark, d).orderBy("pid").limit(10).collect()], np.float64)


def cluster_assign(spark, d):
    a = kmedian.assign(_points(spark, d), _first_centres(spark, d), WIDTH)
    return a.select("pid", "centre", F.round("cost", 6).alias("cost"))


def cluster_centroids(spark, d):
    a = kmedian.assign(_points(spark, d), _first_centres(spark, d), WIDTH)
    return kmedian.centroids(a).select(F.col("id").alias("centre"), "weight", F.round(F.get("coord", F.lit(0)), 6).alias("x0"), F.round(F.get("coord", F.lit(63)), 6).alias("x63"))


def open_gain(spark, d):
    """Change of total cost if each of ten further points was opened, centres free to close."""
    pts = Scratch(spark, "gain").write(kmedian.clean_points(_points(spark, d), WIDTH))
    pts._quarry_dim = WIDTH
    cand = np.array([r["coord"] for r in _points(spark, d).orderBy("pid").limit(20).collect()[10:]], np.float64)
    change, _ = kmedian.open_gain(pts, _first_centres(spark, d), cand, 5.0)
    return spark.createDataFrame([(i, round(float(x), 5)) for i, x in enumerate(change)], "candidate int, change double")


def stream_medians(spark, d):
    """Points in chunks of equal id ranges through the median stream."""
    from quarry.session import scratch_dir
    import uuid

    pts = load(spark, d, "points").select("pid", "weight", "coord")
    state = kmedian.MedianStream(spark, f"{scratch_dir(spark)}/medians-{uuid.uuid4().hex}", 128, 5, 10)
    for k in range(2):
        state.process(pts.where(F.col("pid") % 2 == k), k)
    return state.finish().select("id", F.round("weight", 3).alias("weight"))


_R = "r AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS x, (label % 2)::DOUBLE AS y FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT list_transform(range(64), lambda j: ((j * 37) % 19 - 9) / 100.0::DOUBLE) AS w), s AS (SELECT r.*, list_dot_product(x, w.w) AS d FROM r, w)"
_STEP = f"WITH {_R}, g AS (SELECT u.j - 1 AS j, sum(s.x[u.j] * (1 / (1 + exp(-d)) - y)) AS g FROM s, (SELECT unnest(range(1, 65)) AS j) u GROUP BY ALL) SELECT j::INT AS pos, round(((j * 37) % 19 - 9) / 100.0::DOUBLE - 0.001::DOUBLE * g, 8) AS weight FROM g"


def _train_sql(rows: str, loss: str, gradient: str, rate: float, epochs: int = 10) -> str:
    """Losses of full-gradient descent from zero; ``gradient`` is a row's part for feature j."""
    steps = [f"WITH {rows}", "n AS (SELECT count(*) AS n FROM r)", "w0 AS (SELECT list_transform(range(64), lambda j: 0.0::DOUBLE) AS w)"]
    for k in range(epochs):
        steps.append(f"s{k} AS MATERIALIZED (SELECT x, y, w, list_dot_product(x, w) AS d, list_dot_product(w, w) AS sq FROM r, w{k})")
        steps.append(f"l{k} AS MATERIALIZED (SELECT avg({loss}) AS loss FROM s{k})")
        steps.append(f"g{k} AS MATERIALIZED (SELECT list(g ORDER BY j) AS g FROM (SELECT u.j, sum({gradient}) AS g FROM s{k}, (SELECT unnest(range(1, 65)) AS j) u GROUP BY u.j))")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT list_transform(range(1, 65), lambda j: w[j] - {rate}::DOUBLE / n * g[j]) AS w FROM w{k}, g{k}, n)")
    return ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS epoch, round(loss, 8) AS loss FROM l{k}" for k in range(epochs))


def _drop_sql(rate: float, epochs: int) -> str:
    """Loss of a least-squares model without each of the features, after so many steps from zero."""
    steps = ["WITH r AS (SELECT embedding::DOUBLE[] AS x, (label % 2)::DOUBLE AS y FROM embeddings WHERE embedding IS NOT NULL)", "w0 AS (SELECT unnest(range(64)) AS c, list_transform(range(64), lambda j: 0.0::DOUBLE) AS w)"]
    for k in range(epochs + 1):
        steps.append(f"s{k} AS MATERIALIZED (SELECT c, x, list_dot_product(x, w) - y AS e FROM r, w{k})")
        steps.append(f"g{k} AS MATERIALIZED (SELECT c, list(g ORDER BY j) AS g FROM (SELECT c, u.j, sum(x[u.j] * e) AS g FROM s{k}, (SELECT unnest(range(1, 65)) AS j) u GROUP BY c, u.j) GROUP BY c)")
        steps.append(f"w{k + 1} AS MATERIALIZED (SELECT c, list_transform(range(1, 65), lambda j: CASE WHEN j - 1 = c THEN 0 ELSE w[j] - {rate}::DOUBLE * g[j] END) AS w FROM w{k} JOIN g{k} USING (c))")
    return ", ".join(steps) + f" SELECT c::VARCHAR AS candidate, round(avg(0.5::DOUBLE * e * e), 8) AS loss FROM s{epochs} GROUP BY c"


_ROWS = "r AS (SELECT embedding::DOUBLE[] AS x, {} AS y FROM embeddings WHERE embedding IS NOT NULL)"
_CL = """p AS (SELECT vec_id AS pid, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS centre, x AS cx FROM (SELECT * FROM p ORDER BY pid LIMIT 10)),
dd AS (SELECT pid, x, centre, list_sum(list_transform(list_zip(x, cx), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM p, c), a AS (SELECT pid, x, centre, dist FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(dist, 9), centre) AS rn FROM dd) WHERE rn = 1)"""

QUERIES = {
    f.__name__: f
    for f in (
        glm_loss, ls_loss, svm_loss, perceptron_loss, glm_grad_epoch, glm_column_epoch, glm_column_to_row_epoch, glm_sparse_gradient, glm_sparse_train, glm_accuracy, glm_predictions, glm_train, svm_train, glm_fold_train, admm_model, gram_matrix, least_squares_model, step_drop_features,
        coreset_rows, minmax_scale, transpose_columns, cluster_assign, cluster_centroids, open_gain, stream_medians,
    )
}

SQL = {
    "glm_loss": f"WITH {_R} SELECT round(avg(ln(1 + exp(d)) - y * d), 8) AS loss FROM s",
    "ls_loss": f"WITH {_R} SELECT round(avg(0.5 * (d - y) * (d - y)), 8) AS loss FROM s",
    "svm_loss": f"WITH {_R} SELECT round(avg(greatest(0, 1 - (2 * y - 1) * d)) + 0.1 * (SELECT list_sum(list_transform(w, lambda v: v * v)) FROM w), 8) AS loss FROM s",
    "perceptron_loss": f"WITH {_R} SELECT round(avg(0.6::DOUBLE * (y - CASE WHEN d >= 0 THEN 1 ELSE 0 END)), 8) AS loss FROM s",
    "glm_grad_epoch": _STEP,
    "glm_column_epoch": _STEP,
    "glm_column_to_row_epoch": _STEP,
    "step_drop_features": _drop_sql(0.0001, 5),
    "glm_train": _train_sql(_ROWS.format("(label % 2)::DOUBLE"), "ln(1 + exp(d)) - y * d", "x[u.j] * (1 / (1 + exp(-d)) - y)", 0.1),
    "svm_train": _train_sql(_ROWS.format("(2 * (label % 2) - 1)::DOUBLE"), "greatest(0, 1 - y * d) + 0.1::DOUBLE * sq", "0.2::DOUBLE * w[u.j] - CASE WHEN 1 - y * d > 0 THEN y * x[u.j] ELSE 0 END", 0.05),
    "glm_sparse_gradient": f"WITH {_R} SELECT (u.j - 1)::INT AS col, round(sum(s.x[u.j] * (1 / (1 + exp(-d)) - y)), 6) AS g FROM s, (SELECT unnest(range(1, 65)) AS j) u GROUP BY ALL",
    "glm_accuracy": f"WITH {_R} SELECT round(avg(CASE WHEN (1 / (1 + exp(-d)) > 0.5)::INT = y THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM s",
    "glm_predictions": f"WITH {_R} SELECT row_id, CASE WHEN 1 / (1 + exp(-d)) > 0.5 THEN 1.0::DOUBLE ELSE -1.0 END AS prediction FROM s",
    "gram_matrix": f"WITH {_R} SELECT (a.k - 1)::INT AS i, (b.k - 1)::INT AS j, round(sum(x[a.k] * x[b.k]), 5) AS g FROM r, (SELECT unnest(range(1, 65)) AS k) a, (SELECT unnest(range(1, 65)) AS k) b GROUP BY ALL",
    "minmax_scale": """SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part))::DOUBLE / (SELECT max(p_size) - min(p_size) FROM part), 9) AS size,
  round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 9) AS price, 1.0::DOUBLE AS intercept FROM part""",
    "transpose_columns": f"WITH {_R} SELECT (u.j - 1)::INT AS col, count(*) AS n, round(sum(x[u.j]), 5) AS total FROM r, (SELECT unnest(range(1, 65)) AS j) u WHERE x[u.j] <> 0 GROUP BY ALL",
    "cluster_assign": f"WITH {_CL} SELECT pid, centre, round(dist, 6) AS cost FROM a",
    "cluster_centroids": f"WITH {_CL} SELECT centre, count(*)::DOUBLE AS weight, round(avg(x[1]), 6) AS x0, round(avg(x[64]), 6) AS x63 FROM a GROUP BY centre",
    "open_gain": f"""WITH {_CL}, k AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS candidate, x AS kx FROM (SELECT * FROM p ORDER BY pid LIMIT 10 OFFSET 10)),
n AS (SELECT candidate, a.centre, a.dist AS old, list_sum(list_transform(list_zip(a.x, kx), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS new FROM a, k),
l AS (SELECT candidate, centre, 5.0::DOUBLE + sum(CASE WHEN new >= old THEN old - new ELSE 0 END) AS low FROM n GROUP BY ALL),
s AS (SELECT candidate, sum(CASE WHEN new < old THEN new - old ELSE 0 END) AS save FROM n GROUP BY ALL)
SELECT s.candidate::INT AS candidate, round(5.0::DOUBLE + save - (SELECT coalesce(sum(low), 0) FROM l WHERE l.candidate = s.candidate AND low > 0), 5) AS change FROM s""",
}
