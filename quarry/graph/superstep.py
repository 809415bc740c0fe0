"""Vertex programs.

A super-step sends a message over every edge of an active vertex, combines the messages of a vertex
and applies the result. Messages combine map-side: a hub receives one row per task. Three modes
give the same fixed point: *push* starts from the active vertices (a small frontier is sent to the
edges, no edge moves), *pull* first cuts the edges down to receivers that still want messages, and
*auto* pulls once the frontier's edges are a good share of all (``PULL_SHARE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.graph.build import Graph
from quarry.session import Scratch, broadcast_if_small


#: Share of all edges from which a frontier's edges are pulled.
PULL_SHARE = 0.05


def superstep(active: DataFrame, g: Graph, message: Callable[[], dict[str, Column]], combine: Callable[[], dict[str, Column]], receivers: DataFrame | None = None, cond: Callable[[], Column] | None = None, mode: str = "push", active_edges: int | None = None) -> DataFrame:
    """Messages of one sweep: ``id`` and the combined columns.

    ``active`` has ``id`` and what messages read; ``message`` names their columns over the joined
    row (active columns, src, dst, weight); ``combine`` their aggregates. Of ``receivers`` only the
    rows that meet ``cond`` receive (all of them without it; every vertex without ``receivers``).
    ``mode`` is push, pull or auto; auto needs ``active_edges``, the number of edges of the frontier.
    """
    if mode not in ("push", "pull", "auto"):
        raise ValueError("mode is push, pull or auto")
    wants = None
    if receivers is not None:
        wants = (receivers.where(cond()) if cond else receivers).select(F.col("id").alias("dst"))
    pull = wants is not None and (mode == "pull" or mode == "auto" and active_edges is not None and active_edges > PULL_SHARE * g.edge_count())
    edges = g.edges.join(wants, "dst", "left_semi") if pull else g.edges
    sent = edges.join(broadcast_if_small(active), edges["src"] == active["id"]).select(F.col("dst"), *[c.alias(n) for n, c in message().items()])
    out = sent.groupBy("dst").agg(*[c.alias(n) for n, c in combine().items()])
    if wants is not None and not pull:
        out = out.join(wants, "dst", "left_semi")
    return out.withColumnRenamed("dst", "id")


class Deltas:
    """State as the tables that each round adds: a round writes its frontier and nothing else.

    Rows are ``id`` and a struct ``m``; of several rows of an id the smallest struct counts. Every
    ``FOLD`` rounds the tables are folded into one, so that plans stay small.
    """

    FOLD = 12

    def __init__(self, spark, label: str):
        self.scratch, self.tables = Scratch(spark, label), []

    def add(self, df: DataFrame) -> tuple[DataFrame, bool]:
        """Writes a frontier; returns it and whether it holds any vertex."""
        out = self.scratch.write(df)
        some = not out.isEmpty()
        if some:
            self.tables.append(out)
        if len(self.tables) > self.FOLD:
            self.tables = [self.scratch.write(self.state())]
        return out, some

    def state(self) -> DataFrame:
        every = self.tables[0]
        for t in self.tables[1:]:
            every = every.unionByName(t)
        return every.select("id", "m").groupBy("id").agg(F.min("m").alias("m"))


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], active_flag: str = "active", max_rounds: int = 100_000, label: str = "steps") -> DataFrame:
    """Repeats ``step(state, round)`` while any row is active. Each round is one job: its state is
    written, which cuts the lineage, and the active rows are counted while it is."""
    scratch = Scratch(state.sparkSession, label)

    def keep(df: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        out = scratch.write(df.observe(seen, F.count_if(F.col(active_flag)).alias("n")))
        return out, seen.get["n"]

    cur, active = keep(state)
    for k in range(1, max_rounds + 1):
        if not active:
            return cur
        new, active = keep(step(cur, k))
        scratch.drop(cur)
        cur = new
    raise RuntimeError(f"not settled after {max_rounds} rounds")
