import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quarry.graph import algorithms, build, superstep, validate
from quarry.graph.components import connected_components
from quarry.sources import files, generators, kronecker


def graph(spark, edges, **kw):
    return build.build(spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double"), **kw)


LINE = [(0, 1, 1), (1, 2, 2), (2, 3, 1), (3, 3, 1), (5, 6, 1), (0, 1, 1), (0, 3, 9)]


def test_build_and_degrees(spark):
    g = graph(spark, LINE, dense_ids=True)
    assert {r["id"]: r["out_degree"] for r in build.degrees(g).collect()} == {0: 2, 1: 2, 2: 2, 3: 3, 4: 0, 5: 1, 6: 1}
    assert build.summary(g).first()["isolated"] == 1
    assert graph(spark, LINE, weighted=True).edges.where("src = 0 and dst = 1").count() == 2


def test_bfs_and_sssp(spark):
    g = graph(spark, LINE, weighted=True)
    b = {r["id"]: (r["parent"], r["depth"]) for r in algorithms.bfs(g, 0).collect()}
    assert b == {0: (0, 0), 1: (0, 1), 3: (0, 1), 2: (1, 2), 5: (-1, -1), 6: (-1, -1)}
    s = {r["id"]: r["dist"] for r in algorithms.sssp(g, 0).collect()}
    assert s[3] == 4.0 and s[5] == float("inf")


def test_many_roots_and_their_edges(spark):
    g = graph(spark, LINE)
    tree = algorithms.bfs_many(g, [0, 5, 77])
    assert {(r["root"], r["id"]): r["depth"] for r in tree.collect()} == {(0, 0): 0, (0, 1): 1, (0, 3): 1, (0, 2): 2, (5, 5): 0, (5, 6): 1}
    got = {r["root"]: (r["reached"], r["levels"], r["traversed"]) for r in algorithms.search_summary(g, tree).collect()}
    assert got == {0: (4, 2, 5), 5: (2, 1, 1)}
    assert algorithms.bfs_many(g, [77]).count() == 0


@pytest.mark.parametrize("mode", ["push", "pull", "auto"])
def test_modes_of_a_super_step_agree(spark, mode):
    g = graph(spark, LINE)
    active = spark.createDataFrame([(0,), (3,)], "id long")
    free = spark.createDataFrame([(1, True), (2, True), (3, False)], "id long, open boolean")
    got = superstep.superstep(active, g, lambda: {"p": F.col("src")}, lambda: {"p": F.min("p")}, free, lambda: F.col("open"), mode, active_edges=5)
    assert {r["id"]: r["p"] for r in got.collect()} == {1: 0, 2: 3}
    with pytest.raises(ValueError):
        superstep.superstep(active, g, dict, dict, mode="other")


def test_states_of_many_rounds_are_folded(spark):
    g = graph(spark, [(k, k + 1, 1) for k in range(30)])
    assert algorithms.bfs(g, 0).agg({"depth": "max"}).first()[0] == 30


def test_search_roots_have_edges_and_repeat(spark):
    g = graph(spark, LINE, dense_ids=True)
    a = [r["id"] for r in algorithms.search_roots(g, 4, seed=3).collect()]
    assert a == [r["id"] for r in algorithms.search_roots(g, 4, seed=3).collect()] and len(set(a)) == 4 and 4 not in a


def test_shrinking_keeps_components(spark):
    df = spark.range(3000).selectExpr("id % 700 as src", "case when id % 3 = 0 then 0 else (id * 7) % 700 end as dst")
    want = {}
    for r in df.collect():
        want.setdefault(r["src"], set()).add(r["dst"])
    low = {v: v for k, x in want.items() for v in (k, *x)}
    for _ in range(20):
        for k, x in want.items():
            m = min(low[v] for v in (k, *x))
            for v in (k, *x):
                low[v] = m
    assert {r["id"]: r["component"] for r in connected_components(df.repartition(7)).collect()} == low


def test_validators_find_faults(spark):
    g = graph(spark, LINE, weighted=True)
    tree = algorithms.bfs(g, 0)
    bad = tree.selectExpr("id", "case when id = 2 then 0 else parent end as parent", "depth")
    assert validate.check_bfs(g, bad, 0).first()["no_edge"] == 1
    far = algorithms.sssp(g, 0).selectExpr("id", "dist + case when id = 3 then 1 else 0 end as dist", "parent")
    r = validate.check_sssp(g, far, 0).first()
    assert r["slack_edges"] > 0 and r["loose_links"] > 0
    cc = algorithms.connected_components(g).selectExpr("id", "case when id = 6 then 0 else component end as component")
    assert validate.check_components(g, cc).first()["split_edges"] == 2


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40))
def test_components_property(spark, edges):
    low = {v: v for e in edges for v in e}
    for _ in range(len(low)):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r["id"]: r["component"] for r in connected_components(df).collect()} == low


def test_components_empty_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")
    assert connected_components(df).count() == 0


def test_long_path_components(spark):
    df = spark.range(1, 300).selectExpr("id as src", "id - 1 as dst")
    assert connected_components(df).where("component <> 0").count() == 0


def test_pagerank_delta_isolated(spark):
    g = graph(spark, [(0, 1, 0), (3, 3, 0)], dense_ids=True)
    r = {x["id"]: x["rank"] for x in algorithms.pagerank_delta(g, eps=1e-3).collect()}
    assert r[2] == pytest.approx(0.15 / 4)


def test_kronecker(spark):
    df = kronecker.kronecker_edges(spark, 8, 1000, partitions=7)
    a = sorted(map(tuple, df.select("src", "dst").collect()))
    b = kronecker.edge_range(8, 111, 222, 0, 1000)
    assert a == sorted(zip(b[0].tolist(), b[1].tolist())) and max(max(x) for x in a) < 256
    w = [r["weight"] for r in kronecker.kronecker_edges(spark, 6, 100, weighted=True).collect()]
    assert all(0 <= x < 1 for x in w) and len(set(w)) > 90


def test_recurrence_jump():
    import numpy as np

    s = kronecker.spread_seed(5, 9)
    cur = list(s)
    for _ in range(13):
        cur = [(kronecker.FACTOR_1 * cur[0] + kronecker.FACTOR_5 * cur[4]) % kronecker.MODULUS, *cur[:4]]
    assert kronecker._apply(kronecker.jump(13), np.array(s, np.uint64)[:, None])[:, 0].tolist() == cur


def test_edge_files(spark, tmp_path):
    src = tmp_path / "e.tsv"
    src.write_text("# head\n1 2 0.5\n3\t4  1\n\n")
    assert sorted(map(tuple, files.read_edges(spark, str(src), weighted=True).collect())) == [(1, 2, 0.5), (3, 4, 1.0)]
    with pytest.raises(ValueError):
        files.read_edges(spark, str(src), "bin")
    files.write_edges(files.read_edges(spark, str(src)), str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()][0] == "5 2"


def test_generators(spark):
    t = generators.order_entry(spark, 1, 2, 10, 20)
    assert t["stock"].count() == 20 and t["customer"].count() == 20 and t["new_order"].count() == 6
    b = generators.brokerage(spark, 10, 5, 100)
    assert b["trade"].count() == 100 and b["holding_summary"].count() > 0
    assert generators.transaction_mix(spark, 1000, {"a": 45, "b": 55}).where("kind = 'a'").count() in range(400, 500)
