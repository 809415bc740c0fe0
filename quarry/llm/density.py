"""Similarity clusters by density peaks.

One blocked neighbour join (see ``vectors``) gives every point its local density (how many points
lie within ``radius``), denser neighbours to follow, and the links inside its block as a spanning
forest, never as all pairs. A block does not know densities over all blocks yet; it ranks its rows
by the share of the block that lies within the radius, and offers a point the nearest neighbour of
higher rank and the highest-ranked one. Of what its blocks offer, a point follows the nearest that
is denser indeed (of equals: with a smaller id); points without one are peaks, and pointers lead
down to them. Peaks whose basins touch (a link within ``radius`` crosses the border) are one
cluster, so that a cluster is closed under links; ``peak`` divides it into the basins it consists
of, and ``density`` orders its members.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.graph.components import connected_components
from quarry.llm import vectors as V
from quarry.session import Scratch

#: kind 0: neighbour of higher rank (id, other, d2); kind 1: part of a density (id, count); kind 2: link (id, other)
_SCHEMA = pa.schema([("kind", pa.int8()), ("id", pa.int64()), ("other", pa.int64()), ("x", pa.float64())])
_DDL = "kind byte, id long, other long, x double"


def _forest(n: int, linked: np.ndarray, links) -> np.ndarray:
    """Smallest member index of each index's component; ``links(rows)`` gives their linked columns."""
    label = np.arange(n)
    free = np.zeros(n, bool)
    free[linked] = True
    for start in linked.tolist():
        if not free[start]:
            continue
        free[start] = False
        front = np.array([start])
        while len(front):
            new = links(front)
            new = new[free[new]]
            label[new] = start
            free[new] = False
            front = new
    return label


def _weigh(near: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Sum of ``copies`` over the true columns of every row."""
    many = np.flatnonzero(copies > 1)
    return near.sum(1) + (near[:, many].astype(np.float64) @ (copies[many] - 1.0)).astype(np.int64)


def _short(*codes: np.ndarray) -> list[np.ndarray]:
    """The same numbers under short names, which compare faster."""
    names, at = np.unique(np.concatenate(codes), return_inverse=True)
    at = at.reshape(-1).astype(np.int16 if len(names) < 1 << 15 else np.int32)
    return np.split(at, np.cumsum([len(c) for c in codes])[:-1])


def _survey(block: V.Block, r2: float):
    n = len(block.ids)
    stored, query = block.stored, block.query
    # Links between stored and querying rows, packed to bits row by row.
    bits = np.zeros((len(stored), (len(query) + 7) // 8), np.uint8)
    # Neighbours that no earlier table has counted, each with its copies.
    count, probed = np.zeros(len(stored), np.int64), np.zeros(len(query), np.int64)
    # Ranks: the share of the other side within the radius.
    rank_s, rank_q = np.zeros(len(stored)), np.zeros(len(query))
    is_probe = np.isin(query, block.probe, assume_unique=True)
    step = max(1, (8 << 20) // max(1, len(query)))
    for s in range(0, len(stored), step):
        d = block.rough(stored[s : s + step], query)
        near = d <= r2 - 2 * block.eps
        i, j = np.nonzero((d <= r2 + 2 * block.eps) & ~near)
        if len(i):
            near[i, j] = block.exact(stored[s + i], query[j]) <= r2
        bits[s : s + step] = np.packbits(near, axis=1)
        # what follows concerns linked rows only
        r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(r):
            continue
        near = near[np.ix_(r, c)]
        held_s, held_q = block.copies[stored[s + r]], block.copies[query[c]]
        weights = near.astype(np.float32)
        rank_s[s + r] = weights @ held_q.astype(np.float32)
        rank_q[c] += held_s.astype(np.float32) @ weights
        a, b = block.met[stored[s + r]], block.met[query[c]]
        for t in range(a.shape[1] - 1):
            a_own, a_ask, b_own, b_ask = _short(a[:, t, 0], a[:, t, 1], b[:, t, 0], b[:, t, 1])
            near &= a_own[:, None] != b_own[None]
            near &= a_own[:, None] != b_ask[None]
            near &= a_ask[:, None] != b_own[None]
        count[s + r] = _weigh(near, held_q)
        # A probe counts what is stored here, but for rows that probe its own bucket: those count there.
        asks = is_probe[c]
        if asks.any():
            back = near[:, asks] & (a[:, None, -1, 1] != b[None, asks, -1, 0])
            probed[c[asks]] += _weigh(back.T, held_s)
    if not bits.any():
        return
    yield from _offers(block, bits, rank_s + block.copies[stored] / (1.0 + len(query)), rank_q + block.copies[query] / (1.0 + len(query)), step)
    for rows, x in ((stored, count), (query, probed)):
        some = x > 0
        yield {"kind": np.ones(some.sum(), np.int8), "id": block.ids[rows[some]], "other": np.zeros(some.sum(), np.int64), "x": x[some].astype(np.float64)}
    # Spanning forest over ids: stored rows link to querying rows; equal ids are one vertex.
    uid, at = np.unique(block.ids, return_inverse=True)
    s_at, q_at = at[stored], at[query]
    row_of = np.full(len(uid), -1)
    row_of[s_at] = np.arange(len(stored))
    nq = len(query)
    probes = np.flatnonzero(row_of[q_at] < 0)  # queries without a stored row of their own
    col_of = np.full(len(uid), -1)
    col_of[q_at] = np.arange(nq)

    def links(front: np.ndarray) -> np.ndarray:
        out = []
        rows = row_of[front]
        rows = rows[rows >= 0]
        if len(rows):
            out.append(q_at[np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[rows], axis=0), count=nq))])
        cols = col_of[front]
        cols = cols[(cols >= 0) & (row_of[front] < 0)] if len(probes) else cols[:0]
        # a query that is stored elsewhere reaches the stored rows that link to it
        if len(cols):
            hit = np.zeros(len(stored), bool)
            for c in cols:
                hit |= (bits[:, c >> 3] >> (7 - (c & 7))) & 1 > 0
            out.append(s_at[hit])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, int)

    some = np.zeros(len(uid), bool)
    some[s_at[bits.any(1)]] = True
    some[q_at[np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=nq).astype(bool)]] = True
    label = _forest(len(uid), np.flatnonzero(some), links)
    other = np.flatnonzero(label != np.arange(len(uid)))
    if len(other):
        yield {"kind": np.full(len(other), 2, np.int8), "id": uid[other], "other": uid[label[other]], "x": np.zeros(len(other))}


def _offers(block: V.Block, bits: np.ndarray, rank_s: np.ndarray, rank_q: np.ndarray, step: int):
    """Per querying row its nearest stored neighbour of no lower rank, and that of the highest rank."""
    stored, query = block.stored, block.query
    rank_s, rank_q = rank_s / len(query), rank_q / len(stored)
    asks = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=len(query)))
    gives = np.flatnonzero(bits.any(1))
    gives = gives[np.argsort(-rank_s[gives], kind="stable")]  # so the first one near has the highest rank
    nearest, dist = np.full(len(asks), -1), np.full(len(asks), np.inf, np.float32)
    top = np.full(len(asks), -1)
    cols = np.arange(len(asks))
    step = max(1, (8 << 20) // len(asks))
    for s in range(0, len(gives), step):
        rows = gives[s : s + step]
        near = np.unpackbits(bits[rows], axis=1, count=len(query))[:, asks].view(bool)
        i = near.argmax(0)
        first = near[i, cols] & (top < 0)
        top[first] = rows[i[first]]
        d = block.rough(query[asks], stored[rows])
        near &= rank_s[rows][:, None] >= rank_q[asks][None]
        np.copyto(d, np.inf, where=~near.T)
        i = d.argmin(1)
        better = d[cols, i] < dist
        nearest[better], dist[better] = rows[i[better]], d[cols, i][better]
    for pick, ok in ((nearest, nearest >= 0), (top, (top >= 0) & (top != nearest))):
        a, b = query[asks[ok]], stored[pick[ok]]
        yield {"kind": np.zeros(len(a), np.int8), "id": block.ids[a], "other": block.ids[b], "x": block.exact(a, b)}


def density_peaks(df: DataFrame, id_col: str, vec_col: str, dim: int, radius: float, tables: int = 3, seed: int = 11, cap: int = V.BLOCK_CAP) -> DataFrame:
    """Columns ``id, cluster, density, peak``: every valid vector with its cluster.

    ``cluster`` is the smallest id of the cluster, ``density`` the number of other points within
    ``radius`` (exact copies included), ``peak`` the density peak it descends to. Every valid vector
    comes out, alone if nothing is near. Invalid vectors are left out.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "density")
    v = V.Vectors(df, id_col, vec_col, dim, scratch)
    members = v.members
    size = v.groups.select(F.col("rep").alias("id"), "low", "copies")
    # A row may carry another id of its group than the representative.
    several = members.join(v.groups.where("copies > 1"), "rep").select("id", "copies")
    rows = V.bucket_rows(v, tables, seed, cap, several)
    r2 = radius * radius
    found = scratch.write(V.for_each_block(rows, dim, _SCHEMA, _DDL, lambda b: _survey(b, r2)), partition_by=["kind"])
    # A block counts every neighbour that no other block or earlier table counts, so the parts add up.
    per_block = found.where("kind = 1").groupBy("id").agg(F.sum("x").alias("x"))
    dens = scratch.write(size.join(per_block, "id", "left").select("id", "low", "copies", (F.coalesce("x", F.lit(0.0)) + F.col("copies") - 1).alias("density")))
    near = found.where("kind = 0").select("id", "other", F.col("x").alias("d2"))
    up = (
        near.join(dens.select("id", "density"), "id")
        .join(dens.select(F.col("id").alias("other"), F.col("density").alias("density2")), "other")
        .where((F.col("density2") > F.col("density")) | ((F.col("density2") == F.col("density")) & (F.col("other") < F.col("id"))))
        .groupBy("id").agg(F.min(F.struct("d2", "other")).alias("s"))
        .select("id", F.col("s.other").alias("ptr"))
    )
    ptr = scratch.write(dens.select("id").join(up, "id", "left").select("id", F.coalesce("ptr", "id").alias("ptr")))
    ptr = _follow(ptr, scratch)
    lab = ptr.select(F.col("id").alias("other"), F.col("ptr").alias("peak2"))
    border = (
        found.where("kind = 2").select("id", "other").join(ptr, "id").join(lab, "other")
        .where("ptr <> peak2").select(F.least("ptr", "peak2").alias("src"), F.greatest("ptr", "peak2").alias("dst")).distinct()
    )
    joined = connected_components(scratch.write(border))
    peaks = ptr.join(joined.select(F.col("id").alias("ptr"), F.col("component")), "ptr", "left").select("id", F.col("ptr").alias("peak"), F.coalesce("component", "ptr").alias("c"))
    peaks = scratch.write(peaks.join(dens.select("id", "low", "density"), "id"))
    lowest = peaks.groupBy("c").agg(F.min("low").alias("cluster"))
    by_rep = scratch.write(peaks.join(lowest, "c").select(F.col("id").alias("rep"), "cluster", "density", "peak"))
    return members.join(by_rep, "rep").select("id", "cluster", F.col("density").cast("long").alias("density"), "peak")


def _follow(ptr: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer doubling to the peaks; pointers only lead to denser points, so there is no cycle."""
    while True:
        nxt = ptr.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"))
        moved = scratch.write(ptr.join(nxt, "ptr").select("id", F.col("ptr2").alias("ptr"), (F.col("ptr") != F.col("ptr2")).alias("moved")))
        scratch.drop(ptr)
        ptr = moved.select("id", "ptr")
        ptr._quarry_path = moved._quarry_path
        if not moved.where("moved").limit(1).count():
            return ptr


def clusters_of_size(points: DataFrame, least: int) -> DataFrame:
    """Rows of ``density_peaks`` whose cluster has at least ``least`` points."""
    big = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cluster")
    return points.join(big, "cluster")


def describe_clusters(points: DataFrame, weights: DataFrame, least: int = 1, typical: int = 3) -> DataFrame:
    """Per cluster its size, total weight and its most typical points (densest first, then id).

    ``weights(id, weight)`` must have one row per id; missing weights count nothing.
    """
    p = clusters_of_size(points, least).join(weights, "id", "left")
    sums = p.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    order = Window.partitionBy("cluster").orderBy(F.desc("density"), "id")
    top = p.select("cluster", "id", "density").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical)
    names = top.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("t")).select("cluster", F.concat_ws(",", F.transform("t", lambda x: x["id"].cast("string"))).alias("typical"))
    return sums.join(names, "cluster")
