"""Feature selection and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import Scratch, broadcast_if_small


def weighted_draw(items: DataFrame, draws: DataFrame, id_col: str, weight_col: str) -> DataFrame:
    """Items chosen by draws ``(draw, at)`` with 0 <= at < total weight: item i covers the running
    sum before it up to its own. Weights are positive integers.

    The running sum needs one order over all items: sums per range partition come first, then each
    partition's running sum starts at its offset; the join buckets the weight line, so it stays an
    equi-join.
    """
    spark = items.sparkSession
    scratch = Scratch(spark, "draw")
    part = scratch.write(items.where(F.col(weight_col) > 0).repartitionByRange(F.col(id_col)).withColumn("__p", F.spark_partition_id()))
    sums = part.groupBy("__p").agg(F.sum(weight_col).alias("s"))
    offs = sums.withColumn("__o", F.coalesce(F.sum("s").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    run = F.sum(weight_col).over(Window.partitionBy("__p").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0))
    lined = part.withColumn("__hi", run).join(broadcast_if_small(offs.select("__p", "__o")), "__p").withColumn("__hi", F.col("__hi") + F.col("__o")).withColumn("__lo", F.col("__hi") - F.col(weight_col))
    row = items.agg(F.max(weight_col), F.count(F.lit(1)), F.sum(weight_col)).first()
    width = max(1, int((row[2] or 1) // max(1, row[1])))  # a bucket of the mean weight: an item spans few buckets on average
    cut = lined.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor((F.col("__hi") - 1) / width))))
    hit = draws.withColumn("__b", F.floor(F.col("at") / width)).join(cut, "__b").where("__lo <= at and at < __hi")
    return hit.select(*draws.columns, id_col)


def naive_sample(rows: DataFrame, fraction: float, seed: int = 1, id_col: str = "row_id") -> DataFrame:
    """ceil(f n) rows drawn with replacement: every draw picks the row at a random position."""
    n = rows.count()
    k = int(np.ceil(fraction * n))
    draws = rows.sparkSession.range(k).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(n, 1))).alias("at"))
    picked = weighted_draw(rows.select(id_col).withColumn("__w", F.lit(1).cast("long")), draws, id_col, "__w")
    return picked.join(rows, id_col)


def gram(rows: DataFrame, width: int) -> np.ndarray:
    """X'X: one partial matrix per task, summed; width x width values reach the driver."""
    import pyarrow as pa

    def part(batches):
        g = np.zeros((width, width))
        for b in batches:
            x = np.array(b.column(0).flatten()).reshape(-1, width)
            g += x.T @ x
        yield pa.record_batch([pa.array(np.arange(width * width)), pa.array(g.reshape(-1))], names=["i", "v"])

    cells = rows.select("features").mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * width)
    for r in cells:
        out[r["i"]] = r["v"]
    return out.reshape(width, width)


def least_squares(rows: DataFrame, width: int) -> np.ndarray:
    """The model of least squared error, from X'X and X'y in one pass (the shortest if several)."""
    g = gram(rows.select(F.concat("features", F.array(F.col("label").cast("double"))).alias("features")), width + 1)
    return np.linalg.pinv(g[:width, :width]) @ g[:width, width]


def leverage(rows: DataFrame, width: int) -> DataFrame:
    """Adds ``score`` = x (X'X)^-1 x' to every row."""
    inv = np.linalg.pinv(gram(rows, width))

    @F.pandas_udf("double")
    def score(s):
        x = np.stack(s.to_numpy()) if len(s) else np.zeros((0, width))
        import pandas as pd

        return pd.Series(np.einsum("ij,jk,ik->i", x, inv, x))

    return rows.withColumn("score", score("features"))


def coreset(rows: DataFrame, width: int, per_score: int = 100, seed: int = 1) -> DataFrame:
    """Rows drawn with replacement by leverage; 2 (sum of scores - 1) * ``per_score`` of them."""
    scratch = Scratch(rows.sparkSession, "coreset")
    scored = scratch.write(leverage(rows, width).withColumn("__w", (F.col("score") * 1_000_000_000).cast("long") + 1))
    total, s = scored.agg(F.sum("__w"), F.sum("score")).first()
    n = max(1, int(2 * (s - 1) * per_score))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("at"))
    return weighted_draw(scored.select("row_id", "__w"), draws, "row_id", "__w").join(scored.drop("__w"), "row_id")


def keep_columns(features: list[int], chosen: list[int]) -> list[int]:
    """Features that are chosen, in their order."""
    return [f for f in features if f in set(chosen)]


def remove_columns(features: list[int], gone: list[int]) -> list[int]:
    return [f for f in features if f not in set(gone)]


def join_columns(a: list[int], b: list[int]) -> list[int]:
    """Union in order of first appearance."""
    return list(dict.fromkeys([*a, *b]))


def project(rows: DataFrame, features: list[int]) -> DataFrame:
    return rows.withColumn("features", F.array(*[F.get("features", F.lit(i)) for i in features]))


def transpose(rows: DataFrame) -> DataFrame:
    """Column store in long form: ``col, row, val`` without zeros."""
    return rows.select(F.col("row_id").alias("row"), F.posexplode("features").alias("col", "val")).where("val <> 0").select("col", "row", "val")


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every column scaled to 0..1 and an ``intercept`` of 1; a constant column becomes 0."""
    r = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).first()
    scaled = [F.when(F.lit(r[c]["hi"] == r[c]["lo"]), F.lit(0.0)).otherwise((F.col(c) - r[c]["lo"]) / ((r[c]["hi"] or 0) - (r[c]["lo"] or 0) or 1)).alias(c) for c in columns]
    return df.select(*[c for c in df.columns if c not in columns], *scaled, F.lit(1.0).alias("intercept"))


def step_search(rows: DataFrame, candidates: dict[str, list[int]], epochs: int = 5, rate: float = 0.001) -> DataFrame:
    """``candidate, loss`` of a least-squares fit per feature set, all in the same passes.

    Each pass returns the gradients of every candidate, summed per position by Spark; the models live
    on the driver, a vector per candidate.
    """
    import pyarrow as pa

    names = list(candidates)
    models = [np.zeros(len(candidates[n])) for n in names]
    # positions of a pass: per candidate its gradient and its loss, and the number of rows at the end
    start = np.cumsum([0] + [len(m) + 1 for m in models])
    src = rows.select("features", F.col("label").cast("double"))
    loss = np.zeros(len(names))
    for _ in range(epochs + 1):
        now = [m.copy() for m in models]

        def part(batches, now=now):
            out = np.zeros(start[-1] + 1)
            for b in batches:
                y = b.column(1).to_numpy()
                x = np.array(b.column(0).flatten()).reshape(len(y), -1)
                out[-1] += len(y)
                for i, name in enumerate(names):
                    xi = x[:, candidates[name]]
                    e = xi @ now[i] - y
                    out[start[i] : start[i + 1] - 1] += xi.T @ e
                    out[start[i + 1] - 1] += 0.5 * float(e @ e)
            yield pa.record_batch([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "v"])

        got = src.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        sums = np.zeros(start[-1] + 1)
        sums[got.column("i").to_numpy()] = got.column("v").to_numpy()
        loss = sums[start[1:] - 1] / max(sums[-1], 1)
        models = [m - rate * sums[start[i] : start[i + 1] - 1] for i, m in enumerate(models)]
    return rows.sparkSession.createDataFrame([(a, float(b)) for a, b in zip(names, loss)], "candidate string, loss double")


def step_drop(rows: DataFrame, features: list[int], **kw) -> list[int]:
    """The features without the one whose loss is missed least."""
    tried = step_search(rows, {str(f): remove_columns(features, [f]) for f in features}, **kw)
    worst = tried.orderBy("loss", F.col("candidate").cast("int")).first()["candidate"]
    return remove_columns(features, [int(worst)])


def step_add(rows: DataFrame, features: list[int], pool: list[int], **kw) -> list[int]:
    """The features with the one of the pool that lowers the loss most."""
    tried = step_search(rows, {str(f): join_columns(features, [f]) for f in pool}, **kw)
    best = tried.orderBy("loss", F.col("candidate").cast("int")).first()["candidate"]
    return join_columns(features, [int(best)])
