"""Breadth-first search, components, shortest paths and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.graph import components
from quarry.graph.build import Graph, degrees
from quarry.graph.superstep import Deltas, iterate, superstep
from quarry.session import Scratch, broadcast_if_small


def bfs(g: Graph, root: int) -> DataFrame:
    """``id, parent, depth``: the root is its own parent, unreached vertices have -1 and -1.

    Of several parents one level up the smallest is taken.
    """
    done = bfs_many(g, [root]).select("id", "parent", "depth")
    return g.vertices.join(done, "id", "left").select("id", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def bfs_many(g: Graph, roots: list[int]) -> DataFrame:
    """``root, id, parent, depth`` of the vertices that each of several roots reaches, searched at once.

    A round writes the new frontier only. Roots that are no vertex reach nothing.
    """
    spark, deltas = g.spark, Deltas(g.spark, "bfs")
    start = spark.createDataFrame([(r,) for r in dict.fromkeys(roots)], "root long").join(g.vertices.withColumnRenamed("id", "root"), "root", "left_semi")
    key = lambda r, v: F.struct(F.col(r).alias("root"), F.col(v).alias("v"))
    front, some = deltas.add(start.select(key("root", "root").alias("id"), F.struct(F.lit(0).alias("depth"), F.col("root").alias("parent")).alias("m")))
    depth = 0
    while some:
        depth += 1
        active = front.select("id.root", F.col("id.v").alias("src"))
        sent = g.edges.join(broadcast_if_small(active), "src").groupBy("root", "dst").agg(F.min("src").alias("parent"))
        new = sent.select(key("root", "dst").alias("id"), F.struct(F.lit(depth).alias("depth"), F.col("parent").alias("parent")).alias("m"))
        front, some = deltas.add(new.join(deltas.state().select("id"), "id", "left_anti"))
    if not deltas.tables:
        return spark.createDataFrame([], "root long, id long, parent long, depth int")
    return deltas.state().select("id.root", F.col("id.v").alias("id"), "m.parent", "m.depth")


def search_summary(g: Graph, tree: DataFrame) -> DataFrame:
    """Per root of ``bfs_many``: vertices reached, levels, and edges traversed (ends of undirected edges
    count once), from which ``scalars.per_second`` makes the traversal rate."""
    d = degrees(g)
    half = 1 if g.directed else 2
    loops = g.edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("loops"))
    ends = F.col("out_degree") + (F.coalesce("loops", F.lit(0)) if not g.directed else F.lit(0))
    return tree.join(d, "id").join(loops, "id", "left").groupBy("root").agg(F.count(F.lit(1)).alias("reached"), F.max("depth").alias("levels"), (F.sum(ends) / half).cast("long").alias("traversed"))


def connected_components(g: Graph) -> DataFrame:
    """``id, component`` with the smallest id; isolated vertices are their own."""
    cc = components.connected_components(g.edges)
    return g.vertices.join(cc, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def sssp(g: Graph, root: int) -> DataFrame:
    """``id, dist, parent``: shortest distances over non-negative weights; unreached: infinity and -1.

    Relaxes from the vertices that improved; of equal distances the smallest parent is taken.
    """
    spark, deltas = g.spark, Deltas(g.spark, "sssp")
    start = g.vertices.where(F.col("id") == root).select("id", F.struct(F.lit(0.0).alias("dist"), F.col("id").alias("parent")).alias("m"))
    front, some = deltas.add(start)
    while some:
        sent = superstep(front.select("id", F.col("m.dist").alias("from")), g, lambda: {"m": F.struct((F.col("from") + F.col("weight")).alias("dist"), F.col("src").alias("parent"))}, lambda: {"m": F.min("m")})
        known = deltas.state().select("id", F.col("m.dist").alias("known"))
        front, some = deltas.add(sent.join(known, "id", "left").where(F.col("known").isNull() | (F.col("m.dist") < F.col("known"))).select("id", "m"))
    done = deltas.state() if deltas.tables else start
    return g.vertices.join(done, "id", "left").select("id", F.coalesce("m.dist", F.lit(float("inf"))).alias("dist"), F.coalesce("m.parent", F.lit(-1)).cast("long").alias("parent"))


def pagerank(g: Graph, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """``id, rank``: (1 - d) / n + d * sum(rank / out-degree), a fixed number of rounds.

    Rank of vertices without out-edges is not redistributed.
    """
    scratch = Scratch(g.spark, "pagerank")
    base = scratch.write(degrees(g).select("id", "out_degree"))
    n = base.count()
    cur = base.select("id", "out_degree", F.lit((1 - damping) / max(n, 1)).alias("rank"))
    for k in range(rounds):
        got = superstep(cur.where("out_degree > 0").select("id", (F.col("rank") / F.col("out_degree")).alias("share")), g, lambda: {"m": F.col("share")}, lambda: {"m": F.sum("m")})
        new = base.join(got, "id", "left").select("id", "out_degree", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("m", F.lit(0.0))).alias("rank"))
        cur = scratch.write(new) if k % 4 == 3 else new  # every few rounds, so that plans stay small
    return cur.select("id", "rank")


def pagerank_delta(g: Graph, damping: float = 0.85, eps: float = 1e-9, max_rounds: int = 1000) -> DataFrame:
    """``id, rank``: the delta form in single precision.

    Each vertex sends its change divided by its adjacency size, receivers add d times the sum
    divided by their own out-degree once the sum exceeds eps; smaller sums are kept for later. Ranks
    are not normalised and isolated vertices keep (1 - d) / n.
    """
    base = degrees(g)
    n = base.count()
    init = (1 - damping) / max(n, 1)
    start = base.select("id", "out_degree", F.lit(init).cast("float").alias("rank"), F.lit(init).cast("float").alias("change"), F.lit(0.0).cast("float").alias("held"), (F.col("out_degree") > 0).alias("active"))

    def step(cur: DataFrame, _: int) -> DataFrame:
        got = superstep(cur.where("active").select("id", (F.col("change") / F.col("out_degree")).alias("share")), g, lambda: {"m": F.col("share")}, lambda: {"m": F.sum("m")})
        j = cur.join(got, "id", "left").withColumn("sum", (F.col("held") + F.coalesce("m", F.lit(0.0))).cast("float"))
        go = (F.abs("sum") > eps) & (F.col("out_degree") > 0)
        add = (F.col("sum") * damping / F.col("out_degree")).cast("float")
        return j.select("id", "out_degree", F.when(go, F.col("rank") + add).otherwise(F.col("rank")).cast("float").alias("rank"), F.when(go, add).otherwise(F.lit(0.0)).cast("float").alias("change"), F.when(go, F.lit(0.0)).otherwise(F.col("sum")).cast("float").alias("held"), go.alias("active"))

    return iterate(start, step, max_rounds=max_rounds, label="prdelta").select("id", "rank")


def search_roots(g: Graph, count: int, seed: int = 1) -> DataFrame:
    """Distinct vertices with edges, in a seeded random order."""
    return degrees(g).where(F.col("out_degree") + F.col("in_degree") > 0).select("id").orderBy(F.xxhash64("id", F.lit(seed))).limit(count)
