"""Streaming k-median clustering.

A chunk holds a bounded number of weighted points; one task clusters it by local search over
facility location and returns its weighted centroids, so any number of chunks run side by side. The
centroids are chunked and clustered again until one chunk is left. ``open_gain``, ``assign`` and
``centroids`` are the same steps over a whole distributed table. Every point belongs to its nearest
open centre.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import Scratch

#: Fixed values of the search: candidates per k ln k, and its stopping share.
CANDIDATE_FACTOR = 3
#: Points of a chunk; with 128 coordinates about 20 MB, and twice that for its cost table.
CHUNK_ROWS = 20_000


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(b.column("coord").flatten(), np.float64).reshape(-1, dim)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.maximum(d, 0)


def _reduce(points: DataFrame, f, size: int) -> np.ndarray:
    """Sums f(weights, coords) over all points by position."""
    dim = points._quarry_dim

    def run(batches):
        out = np.zeros(size)
        for b in batches:
            for s in range(0, b.num_rows, 8192):
                c = b.slice(s, 8192)
                out += f(c.column("weight").to_numpy().astype(np.float64), _matrix(c, dim))
        at = np.flatnonzero(out)
        yield pa.record_batch([pa.array(at), pa.array(out[at])], names=["i", "v"])

    got = points.select("weight", "coord").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def clean_points(points: DataFrame, dim: int) -> DataFrame:
    """Points with ``dim`` finite coordinates and a positive weight (null counts as 1); others are left out."""
    c = F.col("coord")
    ok = c.isNotNull() & (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    return points.where(ok & F.col("pid").isNotNull()).select("pid", w.alias("weight"), c.cast("array<double>").alias("coord")).where(~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf")))


def open_gain(points: DataFrame, centres: np.ndarray, candidates: np.ndarray, z: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Per candidate the change of total cost if it is opened (negative is better), and which centres
    would then be closed."""
    k, c = len(centres), len(candidates)

    def part(w, x):
        d = _sq(x, centres)
        own = d.argmin(1)
        cost = w * d[np.arange(len(x)), own]
        new = w[:, None] * _sq(x, candidates)
        diff = new - cost[:, None]
        better = diff < 0
        save = np.where(better, diff, 0).sum(0)
        stay = np.where(better, 0, -diff)  # what the centre's members would lose, as a negative saving
        low = np.zeros((k, c))
        np.add.at(low, own, stay)
        return np.concatenate([save, low.reshape(-1)])

    out = _reduce(points, part, c + k * c)
    low = out[c:].reshape(k, c) + z
    close = low > 0
    return z + out[:c] - np.where(close, low, 0).sum(0), [np.flatnonzero(close[:, i]) for i in range(c)]


def total_cost(points: DataFrame, centres: np.ndarray) -> float:
    """Sum of weight times squared distance to the nearest centre."""
    return float(_reduce(points, lambda w, x: np.array([(w * _sq(x, centres).min(1)).sum()]), 1)[0])


def speedy_opening(d: np.ndarray, z: float, draws: np.ndarray) -> list[int]:
    """Candidates opened in one walk at facility cost z: the first, and each whose cost to those open so
    far, as a share of z, exceeds its draw from [0, 1). ``d[i, j]`` is what j costs when served by i."""
    open_, cost = [0], d[0].copy()
    for i in range(1, len(d)):
        if draws[i] * z < cost[i]:
            open_.append(i)
            np.minimum(cost, d[i], out=cost)
    return open_


#: Facility costs tried before the nearest number of medians is mended by hand.
COST_STEPS = 40
#: Relative gain below which no further candidate is opened.
LEAST_GAIN = 1e-4


def search(w: np.ndarray, x: np.ndarray, kmin: int, kmax: int, seed: int = 1, max_moves: int = 400) -> np.ndarray:
    """Medians of one chunk in memory: between kmin and kmax of them. With at most kmax points every
    point is one.

    Candidates are 3 kmax ln kmax points drawn by weight. For a facility cost z a walk opens a first
    set, then each move opens the candidate that lowers cost + z k most and closes the medians that no
    longer pay. The dearer a facility, the fewer pay: z is the geometric middle of a bracket that
    shrinks around the wanted number. If no z hits it, medians that are missed least are closed, or
    the points served worst are opened.
    """
    if len(x) <= kmax:
        return x.copy()
    rng = np.random.default_rng(seed)
    n = min(len(x), max(kmax + 1, int(CANDIDATE_FACTOR * kmax * math.log(max(2, kmax)))))
    pick = np.sort(np.argsort(rng.exponential(size=len(x)) / w, kind="stable")[:n])
    cand = x[pick]
    d = _sq(cand, x) * w[None]  # candidate x point costs, once
    draws = rng.random(n)
    top = max(float(d[0].sum()), 1e-300)
    low_z, high_z = top / len(x) * 1e-6, top
    open_: list[int] = []
    for _ in range(COST_STEPS):
        z = math.sqrt(low_z * high_z)
        open_ = _settle(d, speedy_opening(d[:, pick], z, draws), z, max_moves)
        if kmin <= len(open_) <= kmax:
            break
        low_z, high_z = (z, high_z) if len(open_) > kmax else (low_z, z)
    while len(open_) > kmax:
        two = np.partition(d[open_], 1, axis=0)[:2]
        own = d[open_].argmin(0)
        open_.pop(int(np.bincount(own, weights=two[1] - two[0], minlength=len(open_)).argmin()))
    while len(open_) < min(kmin, n):
        gain = np.maximum(d[open_].min(0)[None] - d, 0).sum(1)
        gain[open_] = -1
        open_.append(int(gain.argmax()))
    return cand[open_]


def _settle(d: np.ndarray, open_: list[int], z: float, max_moves: int) -> list[int]:
    """Opens and closes candidates while that lowers cost + z k by more than ``LEAST_GAIN`` of the cost."""
    at = np.arange(d.shape[1])
    for _ in range(max_moves):
        own = d[open_].argmin(0)
        cost = d[open_][own, at]
        total = float(cost.sum())
        diff = d - cost[None]
        member = np.zeros((len(open_), len(at)))
        member[own, at] = 1
        low = z - np.maximum(diff, 0) @ member.T  # candidate x median: what closing it gives
        change = z + np.minimum(diff, 0).sum(1) - np.maximum(low, 0).sum(1)
        change[open_] = np.inf
        best = int(change.argmin())
        if not change[best] < -LEAST_GAIN * max(total, 1e-12):
            break
        trial = [c for i, c in enumerate(open_) if low[best, i] <= 0] + [best]
        if float(d[trial].min(0).sum()) + z * len(trial) >= total + z * len(open_):
            break
        open_ = trial
    return open_


def _centroids(w: np.ndarray, x: np.ndarray, medians: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = _sq(x, medians).argmin(1)
    weight = np.bincount(own, weights=w, minlength=len(medians))
    member = np.zeros((len(medians), len(x)))
    member[own, np.arange(len(x))] = w
    keep = weight > 0
    return weight[keep], (member @ x)[keep] / weight[keep][:, None]


def chunk_centres(points: DataFrame, dim: int, kmin: int, kmax: int, chunk_rows: int = CHUNK_ROWS, seed: int = 1) -> DataFrame:
    """``pid, weight, coord``: the weighted centroids of every chunk of about ``chunk_rows`` points.

    Chunks are formed by a hash of the point id; a chunk is one group of one task.
    """
    pts = Scratch(points.sparkSession, "chunks").write(clean_points(points, dim))
    chunks = max(1, -(-pts.count() // chunk_rows))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.argsort(t.column("pid").to_numpy(), kind="stable")
        w = t.column("weight").to_numpy()[order]
        x = np.asarray(t.column("coord").combine_chunks().flatten(), np.float64).reshape(-1, dim)[order]
        weight, centre = _centroids(w, x, search(w, x, kmin, kmax, seed))
        first = t.column("chunk")[0].as_py() << 20
        return pa.table({"pid": pa.array(first + np.arange(len(weight))), "weight": pa.array(weight), "coord": pa.array(list(centre), pa.list_(pa.float64()))})

    return pts.withColumn("chunk", F.pmod(F.xxhash64("pid", F.lit(seed)), F.lit(chunks))).groupBy("chunk").applyInArrow(run, "pid long, weight double, coord array<double>")


def kmedian(points: DataFrame, dim: int, kmin: int, kmax: int, chunk_rows: int = CHUNK_ROWS, seed: int = 1) -> DataFrame:
    """``pid, weight, coord`` of the final centres; their weights sum to those of all sound points.

    Levels shrink by chunk_rows / kmax each, so two or three are enough for any size.
    """
    scratch = Scratch(points.sparkSession, "kmedian")
    level = points
    while True:
        centres = scratch.write(chunk_centres(level, dim, kmin, kmax, chunk_rows, seed))
        if centres.count() <= kmax or level.count() <= chunk_rows:
            return centres
        level = centres


def assign(points: DataFrame, centres: np.ndarray, dim: int) -> DataFrame:
    """``pid, weight, coord, centre, cost``: every sound point with its nearest centre (of equals the first)."""

    def run(batches):
        for b in batches:
            d = _sq(_matrix(b, dim), centres)
            own = d.argmin(1)
            yield pa.record_batch([b.column("pid"), b.column("weight"), b.column("coord"), pa.array(own), pa.array(d[np.arange(len(own)), own] * b.column("weight").to_numpy())], names=["pid", "weight", "coord", "centre", "cost"])

    return clean_points(points, dim).mapInArrow(run, "pid long, weight double, coord array<double>, centre long, cost double")


def centroids(assigned: DataFrame) -> DataFrame:
    """Weighted centroids ``id, weight, coord`` of the assigned points; one row per centre and axis is shuffled."""
    axes = assigned.select("centre", "weight", F.posexplode("coord").alias("i", "x"))
    sums = axes.groupBy("centre", "i").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"), F.sum("weight").alias("weight"))
    return sums.groupBy("centre").agg(F.first("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select(F.col("centre").alias("id"), "weight", F.transform("s", lambda v: v["x"]).alias("coord"))


class MedianStream:
    """Batches in, centres out; state is a table of centroids, one part per batch.

    ``process`` may run again for a batch (its part is overwritten), so it fits ``foreachBatch``.
    """

    def __init__(self, spark: SparkSession, state: str, dim: int, kmin: int, kmax: int, max_centres: int = 100_000, chunk_rows: int = CHUNK_ROWS, seed: int = 1):
        self.spark, self.state, self.dim, self.kmin, self.kmax, self.max_centres, self.chunk_rows, self.seed = spark, state.rstrip("/"), dim, kmin, kmax, max_centres, chunk_rows, seed

    def process(self, batch: DataFrame, batch_id: int) -> None:
        part = chunk_centres(batch, self.dim, self.kmin, self.kmax, self.chunk_rows, self.seed)
        part.select((F.lit(batch_id << 40) + F.col("pid")).alias("pid"), "weight", "coord").write.mode("overwrite").parquet(f"{self.state}/batch={batch_id}")
        if self.centres().count() > self.max_centres:
            raise RuntimeError("more centres than the state may hold")

    def centres(self) -> DataFrame:
        return self.spark.read.schema("pid long, weight double, coord array<double>, batch int").parquet(self.state).drop("batch")

    def finish(self) -> DataFrame:
        """Final centres ``id, weight, coord`` over all centroids; weights sum to those of all points."""
        return kmedian(self.centres(), self.dim, self.kmin, self.kmax, self.chunk_rows, self.seed).withColumnRenamed("pid", "id")

    def run(self, stream: DataFrame, checkpoint: str) -> DataFrame:
        """Drains a stream of ``pid, weight, coord`` and finishes."""
        q = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.finish()
