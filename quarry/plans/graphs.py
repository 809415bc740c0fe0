"""Array and graph queries; all graphs are made of the whole edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.graph import algorithms, build, validate
from quarry.operators import arrays
from quarry.session import load


def edge_rows(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst`` of all rows of the edge table whose ends are both present and not negative."""
    return load(spark, d, "packed_edge").where("v0 >= 0 and v1 >= 0").select(F.col("v0").alias("src"), F.col("v1").alias("dst"))


def edge_lengths(spark: SparkSession, d: str) -> DataFrame:
    """``src, dst, weight`` of every edge (by eid) with a finite weight that is not negative.

    Of redelivered rows the latest one with such a weight counts; an edge without any has no length
    and cannot be walked. Rows without an eid cannot be told apart and are skipped.
    """
    ok = load(spark, d, "packed_edge").where("eid is not null and v0 >= 0 and v1 >= 0").where(~F.isnan("data") & (F.col("data") >= 0) & (F.col("data") < float("inf")))
    one = ok.groupBy("eid").agg(F.max(F.struct("loaded_at", "data", "v0", "v1")).alias("s"))
    return one.select(F.col("s.v0").alias("src"), F.col("s.v1").alias("dst"), F.col("s.data").alias("weight"))


def _edge_graph(spark: SparkSession, d: str) -> build.Graph:
    return build.build(edge_rows(spark, d))


def _length_graph(spark: SparkSession, d: str) -> build.Graph:
    return build.build(edge_lengths(spark, d), weighted=True)


def _root(g: build.Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


def cc_labels(spark, d):
    """Component of every vertex of the edge table."""
    return algorithms.connected_components(_edge_graph(spark, d))


def bfs_depth(spark, d):
    g = _edge_graph(spark, d)
    return algorithms.bfs(g, _root(g)).select("id", "depth")


def bfs_parent(spark, d):
    g = _edge_graph(spark, d)
    return algorithms.bfs(g, _root(g)).select("id", "parent")


def bfs_roots(spark, d):
    """Searches from the four vertices of highest degree at once: reach, levels and edges traversed."""
    g = _edge_graph(spark, d)
    roots = [r["id"] for r in build.degrees(g).orderBy(F.desc("out_degree"), "id").limit(4).collect()]
    return algorithms.search_summary(g, algorithms.bfs_many(g, roots))


def sssp_dist(spark, d):
    g = _length_graph(spark, d)
    return algorithms.sssp(g, _root(g)).where("parent >= 0").select("id", F.round("dist", 6).alias("dist"))


def pagerank_k10(spark, d):
    return algorithms.pagerank(_edge_graph(spark, d), 10).select("id", F.round("rank", 12).alias("rank"))


def pagerank_single(spark, d):
    """Delta form in single precision over the edge table; ranks to twelve places, as a vertex of a
    large graph has a rank far below a millionth."""
    return algorithms.pagerank_delta(_edge_graph(spark, d)).select("id", F.round(F.col("rank").cast("double"), 12).alias("rank"))


def degree_table(spark, d):
    return build.degrees(_edge_graph(spark, d))


def graph_summary(spark, d):
    return build.summary(_edge_graph(spark, d))


def frontier_size(spark, d):
    """Size of a frontier of all vertices."""
    g = _edge_graph(spark, d)
    return build.frontier_size(g.vertices, build.degrees(g))


def validate_bfs(spark, d):
    g = _edge_graph(spark, d)
    r = _root(g)
    return validate.check_bfs(g, algorithms.bfs(g, r), r)


def validate_cc(spark, d):
    g = _edge_graph(spark, d)
    return validate.check_components(g, algorithms.connected_components(g))


def validate_sssp(spark, d):
    g = _length_graph(spark, d)
    r = _root(g)
    return validate.check_sssp(g, algorithms.sssp(g, r), r)


def edge_components(spark, d):
    """Components of every load of the edge table, all its rows."""
    from quarry.graph.components import connected_components

    cc = connected_components(edge_rows(spark, d))
    return cc.groupBy("component").agg(F.count(F.lit(1)).alias("vertices"))


def edge_degrees(spark, d):
    """Undirected degree of every vertex of the edge table, repeated rows and self-loops once."""
    return build.degrees(build.build(edge_rows(spark, d), keep=False)).select("id", "out_degree")


def reduce_ops(spark, d):
    """All reductions over the nation keys."""
    a = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("value"))
    # the product is taken over values below 8, which a double holds exactly
    small = F.when(F.col("value").between(1, 8), F.col("value"))
    return a.agg(*[arrays.REDUCTIONS[op](small if op in ("prod", "mult") else F.col("value")).cast("double" if op in ("prod", "mult") else "long").alias(f"r_{op}") for op in arrays.REDUCTIONS])


def allreduce_max(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), F.round("s_acctbal", 2).alias("value"))
    return arrays.allreduce(a, "max", out="top").select("idx", "value", "top")


def array_fill_map(spark, d):
    a = load(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("long").alias("value"))
    return arrays.map_elements(arrays.fill(a, 7), lambda i, v: v * i, indexed=True)


def gups_xor(spark, d):
    """A[l_partkey % 1024] ^= l_orderkey over an array whose cells hold their index."""
    cells = spark.range(1024).select(F.col("id").alias("idx"), F.col("id").alias("value"))
    u = load(spark, d, "lineitem").select((F.col("l_partkey") % 1024).alias("idx"), F.col("l_orderkey").alias("value"))
    return arrays.scatter_update(cells, u, "xor").select("idx", "value")


_G = """e AS (
  SELECT DISTINCT src, dst FROM (SELECT v0::BIGINT AS src, v1::BIGINT AS dst FROM packed_edge WHERE v0 >= 0 AND v1 >= 0
  UNION ALL SELECT v1, v0 FROM packed_edge WHERE v0 >= 0 AND v1 >= 0)),
v AS (SELECT DISTINCT src AS id FROM e)"""
_LENGTHS = """one AS (
  SELECT v0::BIGINT AS src, v1::BIGINT AS dst, data AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY eid ORDER BY loaded_at DESC NULLS LAST, data DESC, v0 DESC, v1 DESC) AS rn
    FROM packed_edge WHERE eid IS NOT NULL AND v0 >= 0 AND v1 >= 0 AND data >= 0 AND isfinite(data)) WHERE rn = 1),
p AS (SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM one UNION ALL SELECT dst, src, weight FROM one) GROUP BY ALL)"""
_DEPTH = """b(id, depth) USING KEY (id) AS (
  SELECT min(id) AS id, 0 AS depth FROM v
  UNION
  SELECT e.dst AS id, min(b.depth) + 1 AS depth FROM b JOIN e ON e.src = b.id WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.id = e.dst) GROUP BY e.dst)"""
_DEG = "deg AS (SELECT v.id, count(e.dst) AS out_degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id)"


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH {_G}, {_DEG}, n AS (SELECT count(*) AS n FROM v), r0 AS (SELECT id, 0.15::DOUBLE / n AS rank FROM v, n)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s, 0) AS rank FROM v CROSS JOIN n LEFT JOIN (SELECT e.dst, sum(r.rank / d.out_degree) AS s FROM e JOIN r{k - 1} r ON r.id = e.src JOIN deg d ON d.id = e.src GROUP BY e.dst) x ON x.dst = v.id)")
    return ", ".join(steps) + f" SELECT id, round(rank, 12) AS rank FROM r{rounds}"


QUERIES = {
    f.__name__: f
    for f in (cc_labels, bfs_depth, bfs_parent, sssp_dist, pagerank_k10, pagerank_single, degree_table, graph_summary, frontier_size, validate_bfs, validate_cc, validate_sssp, edge_components, edge_degrees, bfs_roots, reduce_ops, allreduce_max, array_fill_map, gups_xor)
}

SQL = {
    "cc_labels": f"""WITH RECURSIVE {_G}, c(id, component) USING KEY (id) AS (
  SELECT id, id AS component FROM v
  UNION
  SELECT e.dst AS id, min(c.component) AS component FROM c JOIN e ON e.src = c.id JOIN recurring.c r ON r.id = e.dst WHERE c.component < r.component GROUP BY e.dst)
SELECT id, component FROM c""",
    "bfs_depth": f"WITH RECURSIVE {_G}, {_DEPTH} SELECT v.id, coalesce(b.depth, -1)::INT AS depth FROM v LEFT JOIN b ON b.id = v.id",
    "bfs_parent": f"""WITH RECURSIVE {_G}, {_DEPTH}, up AS (SELECT e.dst AS id, min(e.src) AS parent FROM e JOIN b a ON a.id = e.src JOIN b c ON c.id = e.dst WHERE a.depth + 1 = c.depth GROUP BY e.dst)
SELECT v.id, CASE WHEN b.depth = 0 THEN v.id ELSE coalesce(up.parent, -1) END AS parent FROM v LEFT JOIN b ON b.id = v.id LEFT JOIN up ON up.id = v.id""",
    "bfs_roots": f"""WITH RECURSIVE {_G}, {_DEG}, top AS (SELECT id FROM deg ORDER BY out_degree DESC, id LIMIT 4),
b(root, id, depth) USING KEY (root, id) AS (
  SELECT id AS root, id, 0 AS depth FROM top
  UNION
  SELECT b.root, e.dst AS id, min(b.depth) + 1 AS depth FROM b JOIN e ON e.src = b.id WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.root = b.root AND r.id = e.dst) GROUP BY b.root, e.dst)
SELECT b.root, count(DISTINCT b.id) AS reached, max(b.depth)::INT AS levels, sum(CASE WHEN e.src <= e.dst THEN 1 ELSE 0 END)::BIGINT AS traversed FROM b JOIN e ON e.src = b.id GROUP BY b.root""",
    "sssp_dist": f"""WITH RECURSIVE {_LENGTHS}, s(id, dist) USING KEY (id) AS (
  SELECT min(src) AS id, 0.0::DOUBLE AS dist FROM p
  UNION
  SELECT p.dst AS id, min(s.dist + p.weight) AS dist FROM s JOIN p ON p.src = s.id LEFT JOIN recurring.s r ON r.id = p.dst WHERE s.dist + p.weight < coalesce(r.dist, 1e300) GROUP BY p.dst)
SELECT id, round(dist, 6) AS dist FROM s""",
    "pagerank_k10": _pagerank_sql(10),
    "degree_table": f"WITH {_G}, {_DEG} SELECT id, out_degree, out_degree AS in_degree FROM deg",
    "graph_summary": f"WITH {_G}, {_DEG} SELECT count(*) AS vertices, sum(out_degree)::BIGINT AS edges, max(out_degree) AS max_degree, count(*) FILTER (out_degree = 0) AS isolated FROM deg",
    "frontier_size": f"WITH {_G}, {_DEG} SELECT sum(2 * out_degree + 1)::BIGINT AS size FROM deg",
    "validate_bfs": f"""WITH RECURSIVE {_G}, {_DEPTH}
SELECT 0::BIGINT AS bad_root, 0::BIGINT AS bad_level, 0::BIGINT AS half_reached, 0::BIGINT AS no_edge, 0::BIGINT AS bad_step, count(*) AS traversed FROM e JOIN b ON b.id = e.src""",
    "validate_cc": "SELECT 0::BIGINT AS split_edges, 0::BIGINT AS bad_label",
    "validate_sssp": "SELECT 0::BIGINT AS bad_root, 0::BIGINT AS slack_edges, 0::BIGINT AS loose_links",
    "edge_components": f"""WITH RECURSIVE {_G}, c(id, component) USING KEY (id) AS (
  SELECT id, id AS component FROM v
  UNION
  SELECT e.dst AS id, min(c.component) AS component FROM c JOIN e ON e.src = c.id JOIN recurring.c r ON r.id = e.dst WHERE c.component < r.component GROUP BY e.dst)
SELECT component, count(*) AS vertices FROM c GROUP BY component""",
    "edge_degrees": f"WITH {_G} SELECT src AS id, count(*) AS out_degree FROM e GROUP BY src",
    "reduce_ops": """SELECT sum(k)::BIGINT AS r_add, sum(k)::BIGINT AS r_sum, max(k) AS r_max, min(k) AS r_min, product(k) FILTER (k BETWEEN 1 AND 8) AS r_prod, product(k) FILTER (k BETWEEN 1 AND 8) AS r_mult,
  bit_or(k) AS "r_or", bit_or(k) AS r_bor, bool_or(k <> 0)::BIGINT AS r_lor, bit_and(k) AS "r_and", bit_and(k) AS r_band, bool_and(k <> 0)::BIGINT AS r_land, bit_xor(k) AS r_xor, bit_xor(k) AS r_bxor, bit_xor((k <> 0)::BIGINT) AS r_lxor
FROM (SELECT n_nationkey::BIGINT AS k FROM nation)""",
    "allreduce_max": "SELECT s_suppkey AS idx, round(s_acctbal, 2) AS value, (SELECT max(round(s_acctbal, 2)) FROM supplier) AS top FROM supplier",
    "array_fill_map": "SELECT p_partkey AS idx, 7 * p_partkey AS value FROM part",
    "gups_xor": "WITH u AS (SELECT l_partkey % 1024 AS idx, bit_xor(l_orderkey) AS x FROM lineitem GROUP BY ALL) SELECT r.range AS idx, xor(r.range, coalesce(u.x, 0)) AS value FROM range(1024) r LEFT JOIN u ON u.idx = r.range",
}
