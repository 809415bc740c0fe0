"""Graphs from edge lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import Scratch


@dataclass
class Graph:
    """``edges(src, dst, weight)`` (both directions of an undirected graph), vertices 0..nv-1 or ids."""

    edges: DataFrame
    vertices: DataFrame
    directed: bool
    _edge_count: int | None = None

    def edge_count(self) -> int:
        if self._edge_count is None:
            self._edge_count = self.edges.count()
        return self._edge_count

    @property
    def spark(self):
        return self.edges.sparkSession


def build(edges: DataFrame, directed: bool = False, weighted: bool = False, dense_ids: bool = False, keep: bool = True) -> Graph:
    """A graph from ``src, dst[, weight]``; rows with a null end are skipped.

    Undirected graphs hold both directions, a self-loop once. Unweighted graphs lose repeated edges,
    weighted ones keep parallel edges. With ``dense_ids`` every id below the largest is a vertex,
    linked or not; else only ids that occur. ``keep`` writes the edges once, in ranges of
    (source, target), so that a hub's edges are cut into even pieces.
    """
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(0.0)
    e = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), w.alias("weight"))
    if not directed:
        e = e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    if not weighted:
        e = e.select("src", "dst", F.lit(0.0).alias("weight")).distinct()
    if keep:
        e = Scratch(edges.sparkSession, "graph").write(e.repartitionByRange("src", "dst").sortWithinPartitions("src"))
    if dense_ids:
        top = e.agg(F.max(F.greatest("src", "dst"))).first()[0]
        v = edges.sparkSession.range(0, 0 if top is None else top + 1)
    else:
        v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return Graph(e, v, directed)


def degrees(g: Graph) -> DataFrame:
    """``id, out_degree, in_degree`` for every vertex; equal in an undirected graph."""
    both = g.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(g.edges.select("dst", F.lit(0), F.lit(1)))
    d = both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.vertices.join(d, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def summary(g: Graph) -> DataFrame:
    """``vertices, edges, max_degree, isolated``."""
    d = degrees(g)
    return d.agg(F.count(F.lit(1)).alias("vertices"), F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"), F.coalesce(F.max("out_degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum((F.col("out_degree") + F.col("in_degree") == 0).cast("long")), F.lit(0)).alias("isolated"))


def frontier_size(active: DataFrame, degree: DataFrame) -> DataFrame:
    """Sum of out + in + 1 over active vertices."""
    return active.join(degree, "id").agg(F.coalesce(F.sum(F.col("out_degree") + F.col("in_degree") + 1), F.lit(0)).alias("size"))
