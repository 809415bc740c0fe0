"""The graph queries over the whole edge table against brute force."""

import datetime
import heapq

import pytest

from quarry.plans import graphs

NAN = float("nan")
#: eid, v0, v1, data, day of loading
EDGES = [(1, 0, 1, 4.0, 1), (1, 0, 1, 4.0, 2), (2, 1, 2, 1.0, 1), (3, 0, 2, 9.0, 1), (3, 0, 2, NAN, 3), (4, 2, 3, NAN, 1), (5, 3, 4, 2.0, 1), (6, 4, 0, 0.5, 1), (7, 5, 5, 1.0, 1)]
EDGES += [(8, 6, 7, None, 1), (9, -1, 2, 1.0, 1), (10, None, 3, 1.0, 1), (11, 3, None, 1.0, 1), (12, 1, 4, -3.0, 1), (13, 0, 2, 7.0, 1), (14, 9, 8, 0.0, 1)] + [(20 + i, 0, 20 + i, 0.25 * i, 1) for i in range(30)]
EDGES += [(60 + i, 20 + i, 21 + i, 0.125, 1) for i in range(28)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    rows = [(e, 0, a, b, w, datetime.datetime(2026, 1, t)) for e, a, b, w, t in EDGES]
    spark.createDataFrame(rows, "eid long, load_id int, v0 int, v1 int, data double, loaded_at timestamp").write.parquet(f"{d}/packed_edge.parquet")
    return d


def neighbours(weighted):
    out = {}
    for _, a, b, w, _ in EDGES:
        if a is None or b is None or a < 0 or b < 0 or (weighted and not (w is not None and w >= 0)):
            continue
        for x, y in ((a, b), (b, a)):
            out.setdefault(x, {})
            out[x][y] = min(w, out[x].get(y, w)) if weighted else 0
    return out


def distances(adj, step):
    best, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for u, w in adj[v].items():
            n = d + (w if step is None else step)
            if n < best.get(u, float("inf")):
                best[u] = n
                heapq.heappush(heap, (n, u))
    return best


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_search(spark, folder):
    adj = neighbours(False)
    near = distances(adj, 1)
    assert pairs(graphs.bfs_depth(spark, folder)) == {v: int(near.get(v, -1)) for v in adj}
    up = {v: min((u for u in adj[v] if near.get(u) == near[v] - 1), default=v) if v in near else -1 for v in adj}
    assert pairs(graphs.bfs_parent(spark, folder)) == up


def test_shortest_paths(spark, folder):
    assert pairs(graphs.sssp_dist(spark, folder)) == distances(neighbours(True), None)


def test_labels(spark, folder):
    adj = neighbours(False)
    low = {v: v for v in adj}
    while (new := {v: min([low[v], *(low[u] for u in adj[v])]) for v in adj}) != low:
        low = new
    assert pairs(graphs.cc_labels(spark, folder)) == low


def test_ranks(spark, folder):
    adj = neighbours(False)
    rank = {v: 0.15 / len(adj) for v in adj}
    for _ in range(10):
        rank = {v: 0.15 / len(adj) + 0.85 * sum(rank[u] / len(adj[u]) for u in adj[v]) for v in adj}
    assert pairs(graphs.pagerank_k10(spark, folder)) == pytest.approx(rank, abs=1e-11)


def test_single_precision_ranks(spark, folder):
    adj = neighbours(False)
    init = 0.15 / len(adj)
    rank, change = {v: init for v in adj}, {v: init for v in adj}
    for _ in range(200):
        change = {v: 0.85 * sum(change[u] / len(adj[u]) for u in adj[v]) / len(adj[v]) for v in adj}
        rank = {v: rank[v] + change[v] for v in adj}
    assert pairs(graphs.pagerank_single(spark, folder)) == pytest.approx(rank, abs=1e-6)


@pytest.mark.parametrize("name", ["validate_bfs", "validate_cc", "validate_sssp"])
def test_validators_run_on_the_edge_table(spark, folder, name):
    r = graphs.QUERIES[name](spark, folder).first().asDict()
    assert name != "validate_bfs" or r.pop("traversed") > 0
    assert set(r.values()) == {0}


def test_size(spark, folder):
    adj = neighbours(False)
    n = sum(map(len, adj.values()))
    assert tuple(graphs.graph_summary(spark, folder).first()) == (len(adj), n, max(map(len, adj.values())), 0)
    assert graphs.frontier_size(spark, folder).first()["size"] == 2 * n + len(adj)
