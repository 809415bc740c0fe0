"""Connected components by alternating large-star and small-star contraction.

Every task first shrinks its edges to a spanning forest of stars around the smallest ids (a
disjoint-set forest over its own rows), so that what is contracted over the cluster is at most one
edge per task and vertex. The joins meet one row per vertex on one side; rows of a hub on the other
side are split by the adaptive skew join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Columns ``id, component``: every vertex of an edge with the smallest id it is linked to.

    Direction, repeated edges and null ends (skipped) make no difference; a self-loop makes its
    vertex a component of one. Each round hangs neighbours onto the smallest neighbour, which
    halves distances; minima are combined map-side.
    """
    scratch = Scratch(edges.sparkSession, "cc")
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    vertices = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    cur = scratch.write(e.where("u <> v").mapInArrow(_shrink, "u long, v long").distinct())
    mark = _signature(cur)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        large = _large_star(cur)
        new = scratch.write(_small_star(large))
        now = _signature(new)
        scratch.drop(cur)
        cur = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return vertices.join(cur.select(F.col("u").alias("id"), F.col("v").alias("low")), "id", "left").select("id", F.coalesce("low", "id").alias("component"))


#: Edges that a task joins at a time.
SHRINK_ROWS = 1_000_000


def _shrink(batches):
    """Spanning stars (u, smallest id of its set) of a task's edges, a chunk at a time."""

    def stars(parts):
        t = pa.Table.from_batches(parts)
        ids, code = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
        a, b = code.reshape(2, -1)
        low = np.arange(len(ids))
        while True:
            # hook the larger root onto the smaller, then let every index point to its root
            x, y = low[a], low[b]
            if (x == y).all():
                break
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low[low] != low).any():
                low = low[low]
        at = np.flatnonzero(low != np.arange(len(ids)))
        return pa.record_batch({"u": ids[at], "v": ids[low[at]]})

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= SHRINK_ROWS:
            s = stars(held)
            yield s
            held, n = [], 0
    if held:
        yield stars(held)


def _signature(e: DataFrame) -> tuple:
    """Count and hash sums of the edge set: equal for equal sets."""
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum("v")).first()
    return r[0], r[1], r[2]


def _large_star(e: DataFrame) -> DataFrame:
    """Every vertex hangs its larger neighbours onto its smallest neighbour (or itself)."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every vertex hangs its smaller neighbours and itself onto the smallest of them."""
    down = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()
