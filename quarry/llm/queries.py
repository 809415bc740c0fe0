"""Queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import density, frequent, leakage, packing, residue, similar
from quarry.session import Scratch, load

DIM, RADIUS = 128, 0.75


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    nb = similar.nearest_neighbours(load(spark, d, "points"), "pid", "coord", DIM, k=5, max_distance=RADIUS)
    return similar.similar_pairs(nb).select("pid_a", "pid_b")


def _edge_table(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """Both ends of every edge once (by eid); negative ends become null, as neither is valid."""
    t = load(spark, d, "packed_edge").where("eid is not null")
    end = lambda c: F.max(F.when(F.col(c) >= 0, F.col(c))).alias(c)
    return scratch.write(t.groupBy("eid").agg(end("v0"), end("v1")).select("v0", "v1"))


def _frequent(spark: SparkSession, d: str, share: float) -> DataFrame:
    scratch = Scratch(spark, "frequent")
    found = frequent.frequent_items(_edge_table(spark, d, scratch), ["v0", "v1"], share, scratch=scratch)
    return found.select(F.concat(F.lit("v"), F.col("col").cast("string")).alias("endpoint"), F.col("item").alias("vertex"), "count")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequent(spark, d, 0.002).select("endpoint", "vertex")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The vertices with at least a hundredth of a percent of a column's valid rows, counted."""
    return _frequent(spark, d, 0.0001)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pts = density.density_peaks(load(spark, d, "points"), "pid", "coord", DIM, RADIUS)
    return density.clusters_of_size(pts, 3).select(F.col("cluster").alias("cluster_pid"), F.col("id").alias("pid"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of three points and more with size, total weight and their most typical points."""
    t = load(spark, d, "points")
    pts = density.density_peaks(t, "pid", "coord", DIM, RADIUS)
    w = F.when(~F.isnan("weight") & (F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double"))
    one = t.where("pid is not null").groupBy(F.col("pid").alias("id")).agg(F.max(F.struct("read_at", w.alias("w"))).alias("s")).select("id", F.col("s.w").alias("weight"))
    out = density.describe_clusters(pts, one, least=3)
    return out.select(F.col("cluster").alias("cluster_pid"), "size", F.round("weight", 3).alias("total_weight"), "typical")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    capacity = load(spark, d, "container_spec").where(F.col("spec_id") == 1).first()["capacity_tokens"]
    packed = packing.pack(packing.token_counts(load(spark, d, "documents"), "doc_id", "text"), capacity, scratch)
    return packing.cut_items(packed).select(F.col("id").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The containers of every specification with their documents and unused space.

    Specifications without an id or without a capacity above zero name no container.
    """
    scratch = Scratch(spark, "packing")
    specs = load(spark, d, "container_spec").where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect()
    sizes = scratch.write(packing.token_counts(load(spark, d, "documents"), "doc_id", "text"))
    out = spark.createDataFrame([], "spec_id int, container string, items long, used long, unused long, documents array<long>")
    for spec, capacity in specs:
        packed = packing.containers(packing.pack(sizes, capacity), capacity)
        out = out.unionByName(packed.withColumn("spec_id", F.lit(spec).cast("int")))
    return out


def p6_certificate(spark: SparkSession, d: str) -> DataFrame:
    """Per specification the containers used, the lower bound, and what would break a packing: containers
    above the capacity and documents whose pieces do not add up."""
    scratch = Scratch(spark, "packing")
    sizes = scratch.write(packing.token_counts(load(spark, d, "documents"), "doc_id", "text"))
    rows = []
    for spec, capacity in load(spark, d, "container_spec").where("spec_id is not null and capacity_tokens > 0").select("spec_id", "capacity_tokens").distinct().orderBy("spec_id").collect():
        packed = scratch.write(packing.pack(sizes, capacity))
        used, bound = packing.certificate(packed, capacity)
        over = packing.containers(packed, capacity).where("unused < 0").count()
        lost = sizes.where("size > 0").join(packed.groupBy("id").agg(F.sum("size").alias("held")), "id", "full").where(~F.col("size").eqNullSafe(F.col("held"))).count()
        rows.append((spec, used, bound, over, lost))
    return spark.createDataFrame(rows, "spec_id int, containers long, bound long, overfull long, incomplete long")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(load(spark, d, "documents"), load(spark, d, "eval_item"), "doc_id", "text", "item_id", ["prompt", "answer"], 12)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p7_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its field, length in words and place in the original text."""
    return _leaks(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(load(spark, d, "documents"), "doc_id", "text").select("doc_id")


def p8_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The documents to exclude with the kind of residue and its evidence."""
    return residue.residue(load(spark, d, "documents"), "doc_id", "text")


_EDGES = """e AS (SELECT eid, max(CASE WHEN v0 >= 0 THEN v0 END) AS v0, max(CASE WHEN v1 >= 0 THEN v1 END) AS v1 FROM packed_edge WHERE eid IS NOT NULL GROUP BY eid),
l AS (SELECT 'v0' AS endpoint, v0::BIGINT AS vertex FROM e WHERE v0 IS NOT NULL UNION ALL SELECT 'v1', v1 FROM e WHERE v1 IS NOT NULL),
c AS (SELECT endpoint, vertex, count(*) AS n FROM l GROUP BY ALL),
t AS (SELECT endpoint, sum(n) AS total FROM c GROUP BY ALL)"""

_PAIRS = """pts AS (SELECT DISTINCT pid, coord::DOUBLE[128] AS c FROM (
    SELECT pid, coord, list_filter(coord, lambda x: x IS NOT NULL AND isfinite(x)) AS ok FROM points WHERE pid IS NOT NULL AND len(coord) = 128)
  WHERE len(ok) = 128 AND len(list_filter(ok, lambda x: x <> 0)) > 0),
near AS (SELECT a.pid AS a, b.pid AS b, array_distance(a.c, b.c) AS dist FROM pts a JOIN pts b ON a.pid <> b.pid WHERE array_distance(a.c, b.c) <= 0.75)"""

_CLUSTERS = """cc(pid, low) USING KEY (pid) AS (
  SELECT pid, pid AS low FROM pts
  UNION
  SELECT n.a AS pid, min(c.low) AS low FROM cc c JOIN near n ON n.b = c.pid JOIN recurring.cc r ON r.pid = n.a WHERE c.low < r.low GROUP BY n.a)"""

_WIDE = "".join(chr(0xFEE0 + c) for c in range(0x21, 0x7F))
#: Folded documents, and the word runs and windows of the items: every leak holds an aligned run of six words.
_LEAKS = f"""d AS (SELECT doc_id, regexp_replace(lower(translate(regexp_replace(regexp_replace(regexp_replace(text,
    '&(amp;)?(nbsp|quot|lt|gt|amp|apos|#39|#160|#x27|#xa0|shy|#173|zwj|#8203|#34|#60|#62|#38);', ' ', 'gi'), '<!--.*?-->', ' ', 'gs'), '</?[a-zA-Z][^<>]*>', '', 'g'),
    '{_WIDE.replace("'", "''")}', '{"".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")}')), '[^a-z0-9]+', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, f, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (SELECT item_id, 'prompt' AS f, prompt AS t FROM eval_item UNION ALL SELECT item_id, 'answer', answer FROM eval_item)),
runs AS (SELECT item_id, f, array_to_string(w[k : k + 5], '') AS run FROM (SELECT *, unnest(range(1, len(w) - 4, 6)) AS k FROM i WHERE len(w) >= 12)),
wins AS (SELECT item_id, f, array_to_string(w[k : k + 11], '') AS win FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
cand AS (SELECT DISTINCT doc_id, item_id, f FROM d JOIN runs ON contains(d.t, run))"""

QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_clusters": p4_clusters, "p6_found": p6_found, "p6_containers": p6_containers, "p6_certificate": p6_certificate, "p7_found": p7_found, "p7_passages": p7_passages, "p8_found": p8_found, "p8_reasons": p8_reasons}

SQL = {
    "p1_found": f"""WITH {_PAIRS}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM near)
SELECT DISTINCT least(a, b) AS pid_a, greatest(a, b) AS pid_b FROM r WHERE rn <= 5""",
    "p3_found": f"WITH {_EDGES} SELECT endpoint, vertex FROM c JOIN t USING (endpoint) WHERE n >= 0.002 * total",
    "p3_counts": f"WITH {_EDGES} SELECT endpoint, vertex, n AS count FROM c JOIN t USING (endpoint) WHERE n >= 0.0001 * total",
    "p4_found": f"""WITH RECURSIVE {_PAIRS}, {_CLUSTERS},
s AS (SELECT low, count(*) AS n FROM cc GROUP BY low)
SELECT cc.low AS cluster_pid, cc.pid FROM cc JOIN s USING (low) WHERE s.n >= 3""",
    "p4_clusters": f"""WITH RECURSIVE {_PAIRS}, {_CLUSTERS},
w AS (SELECT pid, w FROM (SELECT pid, CASE WHEN weight > 0 AND isfinite(weight) THEN weight::DOUBLE END AS w,
  row_number() OVER (PARTITION BY pid ORDER BY read_at DESC NULLS LAST, w DESC NULLS LAST) AS rn FROM points WHERE pid IS NOT NULL) WHERE rn = 1),
dens AS (SELECT cc.pid, cc.low, count(n.b) AS density FROM cc LEFT JOIN near n ON n.a = cc.pid GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY density DESC, pid) AS rn FROM dens)
SELECT r.low AS cluster_pid, count(*) AS size, round(sum(w.w), 3) AS total_weight, string_agg(r.pid::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 3) AS typical
FROM r JOIN w USING (pid) GROUP BY r.low HAVING count(*) >= 3""",
    "p7_found": f"""WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM cand JOIN wins USING (item_id, f) JOIN d USING (doc_id) WHERE contains(d.t, win)""",
    "p6_found": """SELECT doc_id FROM documents
WHERE len(regexp_extract_all(text, '[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9 ]')) > (SELECT capacity_tokens FROM container_spec WHERE spec_id = 1)""",
}
