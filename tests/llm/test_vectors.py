import numpy as np
import pytest

from quarry.llm import density as D
from quarry.llm import similar as S
from quarry.llm import vectors as V

SCHEMA = "pid long, coord array<float>, id string"


def frame(spark, points):
    return spark.createDataFrame([(int(i), None if c is None else [None if x is None else float(x) for x in c], "x") for i, c in points], SCHEMA)


def brute_neighbours(points, k, limit):
    ids = np.array([i for i, _ in points])
    x = np.array([c for _, c in points], float)
    out = set()
    for a in range(len(ids)):
        d = ((x - x[a]) ** 2).sum(1)
        order = [b for b in np.lexsort((ids, d)) if b != a][:k]
        out |= {(int(ids[a]), int(ids[b])) for b in order if d[b] <= limit**2}
    return out


def clusters(rng, n, dim, groups, spread):
    mid = np.round(rng.normal(size=(groups, dim)) * 64) / 64
    return [(i, np.round((mid[i % groups] + rng.normal(scale=spread, size=dim)) * 1024) / 1024) for i in range(n)]


@pytest.mark.parametrize("cap", [V.BLOCK_CAP, 16])
def test_neighbours_match_brute_force(spark, cap):
    pts = clusters(np.random.default_rng(3), 300, 32, 6, 0.04)
    got = {(r["id"], r["other"]) for r in S.nearest_neighbours(frame(spark, pts), "pid", "coord", 32, k=5, max_distance=0.75, cap=cap).collect()}
    want = brute_neighbours(pts, 5, 0.75)
    assert len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("cap", [V.BLOCK_CAP, 16])
def test_a_third_are_copies(spark, cap):
    pts = clusters(np.random.default_rng(5), 120, 16, 8, 0.05)
    pts += [(1000 + i, pts[7][1]) for i in range(60)]
    got = {(r["id"], r["other"]) for r in S.nearest_neighbours(frame(spark, pts), "pid", "coord", 16, k=5, max_distance=0.75, cap=cap, tables=6).collect()}
    want = brute_neighbours(pts, 5, 0.75)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    copies = [7, *range(1000, 1060)]
    assert {b for a, b in got if a == 1059} == set(sorted(copies)[:5])


def test_invalid_vectors_and_repeats(spark):
    pts = [(1, [1, 0, 0, 0]), (2, [1, 0, 0, 0.5]), (2, [1, 0, 0, 0.5]), (3, None), (4, []), (5, [1, 0, 0]), (6, [0, 0, 0, 0]), (7, [1, None, 0, 0]), (8, [float("nan"), 0, 0, 1]), (9, [float("inf"), 0, 0, 1])]
    far = [(20, [9, -9, 9, 9]), (21, [-9, 9, -9, -9])]  # they set the scale; two points alone lie opposite their mean
    got = {(r["id"], r["other"], r["distance"]) for r in S.nearest_neighbours(frame(spark, pts + far), "pid", "coord", 4, k=3, max_distance=0.75).collect()}
    assert got == {(1, 2, 0.5), (2, 1, 0.5)}
    assert S.nearest_neighbours(frame(spark, pts[3:]), "pid", "coord", 4).count() == 0
    assert D.density_peaks(frame(spark, pts[3:]), "pid", "coord", 4, 0.75).count() == 0


def test_rotations_keep_lengths_and_hash_widths_follow_the_size():
    lsh = V.CrossPolytope(32, np.zeros(32), 1.0, 2, [32, 8], 5)
    full = lsh.turns[0][0].astype(float)
    assert np.allclose(full.T @ full, np.eye(32), atol=1e-5) and lsh.turns[1][1].shape == (32, 8)
    sizes = [int(np.prod([2 * a for a in V.hash_widths(n, 128)])) for n in (0, 10_000, 250_000, 10**7, 10**9)]
    assert all(max(8, n / V.BUCKET_ROWS) <= b <= 4 * max(8, n / V.BUCKET_ROWS) for n, b in zip((0, 10_000, 250_000, 10**7, 10**9), sizes))


def test_pack_is_exact():
    for x in (np.array([[0.5, 1.25]]), np.array([[0.1, 1e-9]], np.float32).astype(float), np.array([[0.1, 1 / 3]]), np.array([[0.5, 1.0], [0.1, 1 / 3]])):
        assert (V.unpack(V.pack(x), 2).astype(float) == x).all()
    assert V.pack(np.array([[0.5, 1.0], [0.1, 1 / 3]]))[0] == V.pack(np.array([[0.5, 1.0]]))[0]


def test_repeated_and_signed_zero_copies_are_one_vector(spark):
    pts = [(5, [1, 0, 0, 1]), (3, [1, -0.0, 0, 1]), (3, [1, 0, 0, 1]), (9, [0, 1, 1, 0])]
    from quarry.session import Scratch

    v = V.Vectors(frame(spark, pts).repartition(3), "pid", "coord", 4, Scratch(spark, "t"))
    assert {(r["low"], r["copies"]) for r in v.groups.collect()} == {(3, 2), (9, 1)}
    assert {r["id"] for r in v.members.collect()} == {3, 5, 9}


def test_probes_of_a_hot_bucket_are_split(spark):
    # nearly all rows fall into few buckets; blocks of ten rows must find the same neighbours
    rng = np.random.default_rng(2)
    base = np.round(rng.normal(size=16) * 64) / 64
    pts = [(i, np.round((base + rng.normal(scale=0.02, size=16)) * 1024) / 1024) for i in range(150)] + [(900 + i, np.round(rng.normal(size=16) * 1024) / 1024) for i in range(20)]
    one = {(r["id"], r["other"]) for r in S.nearest_neighbours(frame(spark, pts), "pid", "coord", 16, k=5).collect()}
    cut = {(r["id"], r["other"]) for r in S.nearest_neighbours(frame(spark, pts), "pid", "coord", 16, k=5, cap=10).collect()}
    assert one == cut


def test_recall_without_a_distance_limit(spark):
    pts = clusters(np.random.default_rng(13), 2000, 32, 40, 0.15)
    got = {(r["id"], r["other"]) for r in S.nearest_neighbours(frame(spark, pts), "pid", "coord", 32, k=5).collect()}
    want = brute_neighbours(pts, 5, float("inf"))
    assert len(got & want) >= 0.9 * len(want)


def brute_peaks(pts, radius, density):
    ids = np.array([i for i, _ in pts])
    x = np.array([c for _, c in pts], float)
    up = {}
    for a in range(len(ids)):
        d = ((x - x[a]) ** 2).sum(1)
        ok = [b for b in range(len(ids)) if d[b] <= radius**2 and (density[ids[b]], -ids[b]) > (density[ids[a]], -ids[a])]
        up[ids[a]] = ids[min(ok, key=lambda b: (d[b], ids[b]))] if ok else ids[a]
    return up


def test_peaks_are_the_points_without_a_denser_neighbour(spark):
    pts = clusters(np.random.default_rng(4), 400, 16, 5, 0.11)
    rows = D.density_peaks(frame(spark, pts), "pid", "coord", 16, 0.75, tables=8).collect()
    up = brute_peaks(pts, 0.75, {r["id"]: r["density"] for r in rows})
    want = {int(i) for i, j in up.items() if i == j}
    got = {r["peak"] for r in rows}
    assert want <= got and len(got - want) <= 0.02 * len(pts)


def brute_clusters(points, radius):
    ids = [i for i, _ in points]
    x = np.array([c for _, c in points], float)
    low = list(ids)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= radius**2
    while True:
        new = [min(low[b] for b in np.flatnonzero(near[a])) for a in range(len(ids))]
        if new == low:
            return dict(zip(ids, low))
        low = new


@pytest.mark.parametrize("cap", [V.BLOCK_CAP, 12])
def test_clusters_are_closed_under_links(spark, cap):
    rng = np.random.default_rng(8)
    pts = clusters(rng, 120, 16, 4, 0.05)
    # a chain of steps just below the radius joins far ends
    start = np.full(16, 5.0)
    pts += [(500 + i, start + np.eye(16)[0] * 0.7 * i) for i in range(12)]
    pts += [(600 + i, start - 9) for i in range(9)]  # copies
    got = {r["id"]: r["cluster"] for r in D.density_peaks(frame(spark, pts), "pid", "coord", 16, 0.75, tables=8, cap=cap).collect()}
    assert got == brute_clusters(pts, 0.75)


def test_description(spark):
    pts = [(i, [0.0, 1, 0, 0.01 * i]) for i in range(1, 6)] + [(20, [5.0, 5, 5, 5])]
    p = D.density_peaks(frame(spark, pts), "pid", "coord", 4, 0.02 + 1e-6)
    w = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.5)], "id long, weight double")
    r = D.describe_clusters(p, w, least=2).collect()
    assert [(x["cluster"], x["size"], x["weight"], x["typical"].split(",")[0]) for x in r] == [(1, 5, 3.5, "3")]


@pytest.mark.parametrize("cap", [V.BLOCK_CAP, 12])
def test_densities_match_brute_force(spark, cap):
    rng = np.random.default_rng(21)
    pts = clusters(rng, 160, 16, 3, 0.12)
    pts += [(500 + i, pts[4][1]) for i in range(40)] + [(600 + i, pts[11][1]) for i in range(7)]  # copies
    x = np.array([c for _, c in pts], float)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.75**2
    want = {i: int(n) - 1 for (i, _), n in zip(pts, near.sum(1))}
    p = D.density_peaks(frame(spark, pts), "pid", "coord", 16, 0.75, tables=12, cap=cap)
    rows = p.collect()
    assert {r["id"]: r["density"] for r in rows} == want
    w = spark.createDataFrame([(i, 1.0) for i, _ in pts], "id long, weight double")
    low = brute_clusters(pts, 0.75)
    got = {r["cluster"]: [int(i) for i in r["typical"].split(",")] for r in D.describe_clusters(p, w, least=3).collect()}
    best = {c: sorted((i for i in low if low[i] == c), key=lambda i: (-want[i], i))[:3] for c in set(low.values())}
    assert got == {c: t for c, t in best.items() if sum(v == c for v in low.values()) >= 3}
