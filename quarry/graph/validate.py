"""Validators: each returns one row of violation counts, all zero for a right result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.graph.build import Graph


def _n(cond) -> F.Column:
    return F.coalesce(F.sum(F.coalesce(cond, F.lit(True)).cast("long")), F.lit(0))


def _one_row(*parts: DataFrame) -> DataFrame:
    """Single-row counts side by side."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out.agg(*[F.sum(c).alias(c) for x in parts for c in x.columns])


def _ends(g: Graph, state: DataFrame, cols: list[str]) -> DataFrame:
    a = state.select(F.col("id").alias("src"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = state.select(F.col("id").alias("dst"), *[F.col(c).alias(f"b_{c}") for c in cols])
    return g.edges.join(a, "src").join(b, "dst")


def check_bfs(g: Graph, tree: DataFrame, root: int) -> DataFrame:
    """``bad_root, bad_level, half_reached, no_edge, bad_step, traversed``.

    The root is its own parent; ends of an edge differ by one level at most and are both reached or
    neither; every tree edge exists and goes down one level (so there is no cycle). ``traversed``
    counts edges between reached vertices.
    """
    roots = tree.agg(_n(((F.col("id") == root) & (F.col("parent") != root)) | ((F.col("id") != root) & (F.col("parent") == F.col("id")))).alias("bad_root"))
    ends = _ends(g, tree, ["depth"])
    reached = (F.col("a_depth") >= 0) & (F.col("b_depth") >= 0)
    levels = ends.agg(_n(reached & (F.abs(F.col("a_depth") - F.col("b_depth")) > 1)).alias("bad_level") if not g.directed else _n(reached & (F.col("b_depth") - F.col("a_depth") > 1)).alias("bad_level"), _n((F.col("a_depth") >= 0) & (F.col("b_depth") < 0)).alias("half_reached"), _n(reached).alias("traversed"))
    links = tree.where((F.col("parent") >= 0) & (F.col("parent") != F.col("id")))
    known = g.edges.select(F.col("src").alias("parent"), F.col("dst").alias("id")).distinct().withColumn("known", F.lit(True))
    up = tree.select(F.col("id").alias("parent"), F.col("depth").alias("up"))
    steps = links.join(known, ["parent", "id"], "left").join(up, "parent", "left").agg(_n(F.col("known").isNull()).alias("no_edge"), _n(F.col("depth") != F.col("up") + 1).alias("bad_step"))
    return _one_row(roots, levels, steps).select("bad_root", "bad_level", "half_reached", "no_edge", "bad_step", "traversed")


def check_components(g: Graph, labels: DataFrame) -> DataFrame:
    """``split_edges, bad_label``: ends share a label, and a label is the smallest id that carries it."""
    split = _ends(g, labels, ["component"]).agg(_n(F.col("a_component") != F.col("b_component")).alias("split_edges"))
    low = labels.groupBy("component").agg(F.min("id").alias("low")).agg(_n(F.col("low") != F.col("component")).alias("bad_label"))
    return _one_row(split, low)


def check_sssp(g: Graph, state: DataFrame, root: int) -> DataFrame:
    """``bad_root, slack_edges, loose_links``: no edge could shorten a distance; tree links are tight."""
    r = state.agg(_n((F.col("id") == root) & (F.col("dist") != 0)).alias("bad_root"))
    e = _ends(g, state, ["dist"]).agg(_n(F.col("b_dist") > F.col("a_dist") + F.col("weight")).alias("slack_edges"))
    up = state.select(F.col("id").alias("parent"), F.col("dist").alias("up"))
    best = g.edges.groupBy(F.col("src").alias("parent"), F.col("dst").alias("id")).agg(F.min("weight").alias("w"))
    link = state.where((F.col("parent") >= 0) & (F.col("id") != root)).join(up, "parent", "left").join(best, ["parent", "id"], "left").agg(_n(F.col("dist") != F.col("up") + F.col("w")).alias("loose_links"))
    return _one_row(r, e, link)
