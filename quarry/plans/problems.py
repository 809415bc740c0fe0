"""Queries over hierarchies and heavily skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import heavy_keys, hierarchy
from quarry.session import load


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per ``eid`` of the rows whose ends are both present and not negative.

    Redelivered rows carry the same edge; should they differ, the smallest (v0, v1) is taken. Rows
    without an eid cannot be told apart and are skipped. Partitioned by eid, hence evenly.
    """
    ok = edges.where("eid is not null and v0 >= 0 and v1 >= 0")
    packed = ok.select("eid", (F.shiftleft(F.col("v0").cast("long"), 32) + F.col("v1")).alias("e"))
    return packed.groupBy("eid").agg(F.min("e").alias("e")).select("eid", F.shiftright("e", 32).alias("v0"), F.col("e").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v1"))


def p2_resolved(spark: SparkSession, d: str, detail: bool = False) -> DataFrame:
    return hierarchy.resolve_hierarchy(load(spark, d, "bfsdata"), "run_id", "vertex", "parent", "written_at", detail=detail)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r = p2_resolved(spark, d)
    return r.where(F.col("status") != hierarchy.DANGLING).select(F.col("g").alias("run_id"), F.col("v").alias("vertex"), F.col("root").alias("root_vertex"), "depth")


def _named(path: str) -> Column:
    return F.concat_ws("/", F.col(path).cast("array<string>")).alias(path)


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and path of every vertex that has a root, the path in pages: ``page`` is its end
    'a/b/c' of at most 64 vertices, ``before`` the vertex whose own path precedes it (null if none)."""
    r = p2_resolved(spark, d, True).where(F.col("status") == hierarchy.ROOTED)
    return r.select(F.col("g").alias("run_id"), F.col("v").alias("vertex"), F.col("root").alias("root_vertex"), "depth", "before", _named("page"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every vertex that has a root, as an interval: the vertices of its tree whose
    ``pre`` lies in (pre, last]; their number is last - pre."""
    r = p2_resolved(spark, d, True).where(F.col("status") == hierarchy.ROOTED)
    return r.select(F.col("g").alias("run_id"), F.col("v").alias("vertex"), F.col("root").alias("root_vertex"), "pre", "last", (F.col("last") - F.col("pre")).alias("descendants"))


def p2_full_paths(spark: SparkSession, d: str) -> DataFrame:
    """The whole path of every vertex that has a root in one value; as large as all paths together."""
    r = hierarchy.full_paths(p2_resolved(spark, d, True))
    return r.select(F.col("g").alias("run_id"), F.col("v").alias("vertex"), F.col("root").alias("root_vertex"), "depth", _named("path"))


def p2_descendant_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every (ancestor, descendant) of every run with their distance; as many rows as depths sum to."""
    return hierarchy.descendant_pairs(p2_resolved(spark, d, True)).withColumnRenamed("g", "run_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    e = distinct_edges(load(spark, d, "packed_edge"))
    return heavy_keys.key_mode(e, "v0", "v1", min_rows=20).select(F.col("key").cast("int").alias("v0"), F.col("value").cast("int").alias("v1"))


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    """Per v0 its edges and the count, sum and range of their weights in millionths."""
    t = load(spark, d, "packed_edge").where("eid is not null and v0 >= 0 and v1 >= 0")
    w = F.when(~F.isnan("data") & (F.col("data") >= 0) & (F.col("data") < 9e9), F.round(F.col("data") * 1000000).cast("long"))
    one = t.groupBy("eid").agg(F.max(F.struct("loaded_at", w.alias("w"), "v0")).alias("s")).select("s.v0", "s.w")
    return heavy_keys.key_stats(one, "v0", "w").select(F.col("key").cast("int").alias("v0"), F.col("n").alias("edges"), F.col("measured").alias("weighted_edges"), F.col("total").alias("weight_micro"), F.col("low").alias("min_micro"), F.col("high").alias("max_micro"))


_LATEST = """latest AS (
  SELECT run_id, vertex, parent FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, vertex ORDER BY written_at DESC NULLS LAST, parent DESC NULLS LAST) AS rn
    FROM bfsdata WHERE run_id IS NOT NULL AND vertex IS NOT NULL) WHERE rn = 1)"""

_ROOTED = """rooted AS (
  SELECT run_id, vertex, vertex AS root_vertex, 0::BIGINT AS depth, [vertex] AS path FROM latest WHERE parent = vertex AND parent >= 0
  UNION ALL
  SELECT l.run_id, l.vertex, r.root_vertex, r.depth + 1, list_append(r.path, l.vertex)
  FROM latest l JOIN rooted r ON l.run_id = r.run_id AND l.parent = r.vertex WHERE l.vertex <> l.parent)"""

_PAIRS = "pairs AS (SELECT run_id, unnest(path) AS ancestor, vertex AS descendant, depth - unnest(range(0, depth + 1)) AS distance FROM rooted)"

QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_full_paths": p2_full_paths, "p2_descendant_pairs": p2_descendant_pairs, "p5_found": p5_found, "p5_weights": p5_weights}

SQL = {
    "p2_found": f"""WITH RECURSIVE {_LATEST}, {_ROOTED},
dead AS (
  SELECT l.run_id, l.vertex FROM latest l LEFT JOIN latest q ON l.run_id = q.run_id AND l.parent = q.vertex
  WHERE l.parent IS NULL OR l.parent < 0 OR q.vertex IS NULL
  UNION ALL
  SELECT l.run_id, l.vertex FROM latest l JOIN dead d ON l.run_id = d.run_id AND l.parent = d.vertex WHERE l.vertex <> l.parent AND l.parent >= 0),
lost AS (
  SELECT run_id, vertex, parent FROM latest l
  WHERE NOT EXISTS (SELECT 1 FROM rooted r WHERE r.run_id = l.run_id AND r.vertex = l.vertex)
    AND NOT EXISTS (SELECT 1 FROM dead r WHERE r.run_id = l.run_id AND r.vertex = l.vertex)),
walk AS (
  SELECT run_id, vertex AS start, vertex AS at, [vertex] AS seen, false AS closed FROM lost
  UNION ALL
  SELECT w.run_id, w.start, l.parent, CASE WHEN list_contains(w.seen, l.parent) THEN w.seen[list_position(w.seen, l.parent):] ELSE list_append(w.seen, l.parent) END, list_contains(w.seen, l.parent)
  FROM walk w JOIN lost l ON w.run_id = l.run_id AND w.at = l.vertex WHERE NOT w.closed)
SELECT run_id, vertex, root_vertex, depth FROM rooted
UNION ALL
SELECT run_id, start AS vertex, list_min(seen) AS root_vertex, -1::BIGINT AS depth FROM walk WHERE closed""",
    "p2_paths": f"""WITH RECURSIVE {_LATEST}, {_ROOTED}
SELECT run_id, vertex, root_vertex, depth, CASE WHEN depth >= 64 THEN path[depth - depth % 64] END AS before, array_to_string(path[depth - depth % 64 + 1:], '/') AS page FROM rooted""",
    "p2_descendants": f"""WITH RECURSIVE {_LATEST}, {_ROOTED}, {_PAIRS},
n AS (SELECT run_id, ancestor AS vertex, count(*) - 1 AS descendants FROM pairs GROUP BY ALL),
o AS (SELECT run_id, vertex, root_vertex, row_number() OVER (PARTITION BY run_id, root_vertex ORDER BY path) - 1 AS pre FROM rooted)
SELECT run_id, vertex, root_vertex, pre, pre + descendants AS last, descendants FROM o JOIN n USING (run_id, vertex)""",
    "p2_full_paths": f"WITH RECURSIVE {_LATEST}, {_ROOTED} SELECT run_id, vertex, root_vertex, depth, array_to_string(path, '/') AS path FROM rooted",
    "p2_descendant_pairs": f"WITH RECURSIVE {_LATEST}, {_ROOTED}, {_PAIRS} SELECT run_id, ancestor, descendant, distance FROM pairs WHERE distance > 0",
    "p5_found": """WITH e AS (SELECT eid, min((v0::BIGINT << 32) + v1) AS e FROM packed_edge WHERE eid IS NOT NULL AND v0 >= 0 AND v1 >= 0 GROUP BY eid),
c AS (SELECT (e >> 32)::INT AS v0, (e & 4294967295)::INT AS v1, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT v0, v1, row_number() OVER (PARTITION BY v0 ORDER BY n DESC, v1) AS rn, sum(n) OVER (PARTITION BY v0) AS total FROM c)
SELECT v0, v1 FROM r WHERE rn = 1 AND total >= 20""",
    "p5_weights": """WITH t AS (
  SELECT eid, v0, loaded_at, CASE WHEN NOT isnan(data) AND data >= 0 AND data < 9e9 THEN round(data * 1000000)::BIGINT END AS w
  FROM packed_edge WHERE eid IS NOT NULL AND v0 >= 0 AND v1 >= 0),
o AS (SELECT v0, w FROM (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY loaded_at DESC NULLS LAST, w DESC NULLS LAST, v0 DESC) AS rn FROM t) WHERE rn = 1)
SELECT v0, count(*) AS edges, count(w) AS weighted_edges, sum(w)::BIGINT AS weight_micro, min(w) AS min_micro, max(w) AS max_micro FROM o GROUP BY v0""",
}
