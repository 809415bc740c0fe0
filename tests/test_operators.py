import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.ml import engine, models, select
from quarry.operators import arrays, scans
from quarry.sources import files
from quarry.streaming import kmedian


def array(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "idx long, value long")


def test_array_updates(spark):
    a = array(spark, 1, 2, 3)
    u = spark.createDataFrame([(1, 6), (1, 1), (9, 4)], "idx long, value long")
    assert [r["value"] for r in arrays.scatter_update(a, u).orderBy("idx").collect()] == [1, 2 ^ 6 ^ 1, 3]
    assert [r["value"] for r in arrays.write_elements(a, u).orderBy("idx").collect()] == [1, 6, 3]
    assert arrays.reduce_array(a.limit(0), "sum").first()["value"] is None
    assert {r["total"] for r in arrays.allreduce(a, "max").collect()} == {3}


def test_scans(spark):
    t = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert [tuple(r) for r in scans.range_scan(t, ["a", "b"], [0, 1], [1, 1]).collect()] == [(0, 1), (0, 2), (1, 0)]
    assert [tuple(r) for r in scans.reverse_scan(t, ["a", "b"], [1, 1], [0, 1]).collect()] == [(1, 1), (1, 0), (0, 2)]
    assert scans.range_scan(t, ["a"], [1], limit=2).count() == 2
    req = spark.createDataFrame([(0,), (7,)], "a int")
    assert scans.point_lookup(t.where("b = 0"), req, ["a"]).where("found").count() == 1
    assert scans.multi_lookup(t, req, ["a"]).count() == 3


def test_versions_and_changes(spark):
    v = spark.createDataFrame([(1, 1, "a", False), (1, 5, "b", False), (2, 2, "c", False), (2, 3, "c", True), (3, None, "d", False)], "k int, t int, x string, gone boolean")
    assert {(r["k"], r["x"]) for r in scans.as_of(v, ["k"], "t", 4, "gone").collect()} == {(1, "a")}
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    c = spark.createDataFrame([(2, "B"), (3, "C")], "k int, x string")
    assert {tuple(r) for r in scans.upsert(t, c, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in scans.insert_new(t, c, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "C")}
    assert scans.remove(t, c, ["k"]).count() == 1


def test_lots(spark):
    lots = spark.createDataFrame([("s", 1, 10), ("s", 2, 20), ("s", 3, 30)], "s string, t int, q int")
    need = spark.createDataFrame([("s", 25)], "s string, need int")
    take = lambda lifo: {r["t"]: r["taken"] for r in scans.consume_lots(lots, need, ["s"], ["t"], "q", "need", lifo).collect()}
    assert take(False) == {1: 10, 2: 15, 3: 0} and take(True) == {3: 25, 2: 0, 1: 0}


def test_interval_lookup(spark):
    tiers = spark.createDataFrame([(1, 0, 10, "a"), (1, 5, 20, "b")], "k int, lo int, hi int, r string")
    rows = spark.createDataFrame([(1, 7), (1, 15), (1, 99), (1, 7)], "k int, q int")
    assert sorted(r["r"] for r in scans.interval_lookup(rows, tiers, ["k"], "q", "lo", "hi").collect()) == ["a", "a", "b"]


def test_scalars(spark):
    df = spark.createDataFrame([(1, "x A y A")], "n long, s string")
    r = df.select(scalars.reverse_bits(F.col("n")).alias("a"), scalars.swap_bytes(F.col("n")).alias("b"), scalars.toggle(F.col("s"), "A", "B").alias("c"), scalars.toggle(F.lit("B"), "A", "B").alias("d"), scalars.log_loss(F.lit(1000.0), F.lit(0.0)).alias("e")).first()
    assert tuple(r) == (-(1 << 63), 1 << 56, "x B y A", "A", 1000.0)


def dense(spark, n=200, width=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    y = (x @ np.arange(1, width + 1) > 0).astype(float)
    return files.matrix_frame(spark, np.column_stack([x, y])), x, y


def test_engine_matches_numpy(spark):
    rows, x, y = dense(spark)
    e = engine.Engine(rows, 5, partitions=3)
    w = np.full(5, 0.1)
    total, new = e.exec(e.register_row(models.logistic), w, 0.01)
    want, g = models.logistic(x, y, w)
    assert total == pytest.approx(want) and np.allclose(new, w - 0.01 * g)
    _, col = e.exec(e.register_column(models.logistic_column), w, 0.01)
    assert np.allclose(col, new)
    seq = e.register_row(lambda a, b, m, shared: (float(len(b)) * shared, None))
    assert e.exec(seq, w, shared=2.0)[0] == 400
    e.close()
    twice = engine.Engine(rows, 5, replicas=2)
    assert twice.exec(twice.register_row(models.logistic), w)[0] == pytest.approx(2 * want)
    twice.close()


def test_ordered_fold(spark):
    rows, x, y = dense(spark, 40)
    step = lambda xi, yi, w: w - 0.1 * (xi @ w - yi) * xi
    w = np.zeros(5)
    for a, b in zip(x, y):
        w = step(a, b, w)
    assert np.allclose(engine.ordered_fold(rows, 5, step, np.zeros(5)), w)


@pytest.mark.parametrize("kind", ["logistic", "least_squares", "svm"])
@pytest.mark.parametrize("access", ["row", "fold"])
def test_training_lowers_loss(spark, kind, access):
    rows, _, _ = dense(spark)
    if kind == "svm":
        rows = rows.withColumn("label", 2 * F.col("label") - 1)
    f = models.fit(rows, 5, kind, 4, 0.05, access=access, partitions=2)
    assert f.losses[-1] < f.losses[0]


def test_accuracy_and_admm(spark):
    rows, x, y = dense(spark)
    w = models.admm(rows, 5, 5)
    acc = models.accuracy(models.predict(rows, w, low=0.0)).first()[0]
    assert acc > 0.9
    assert np.allclose(models.admm(rows, 5, 2, qr=True), models.admm(rows, 5, 2), atol=1e-4)


def test_wrong_width_is_an_error(spark):
    rows, _, _ = dense(spark)
    with pytest.raises(Exception):
        engine.Engine(rows, 6).blocks.count()


def test_selection(spark):
    rows, x, y = dense(spark)
    assert select.step_add(rows, [0], [1, 4], epochs=3, rate=0.001) in ([0, 1], [0, 4])
    assert len(select.step_drop(rows, [0, 1, 2], epochs=3)) == 2
    assert select.join_columns([1, 2], [2, 3]) == [1, 2, 3] and select.keep_columns([1, 2, 3], [3, 1]) == [1, 3]
    lev = select.leverage(rows, 5).agg(F.sum("score")).first()[0]
    assert lev == pytest.approx(5)
    assert select.naive_sample(rows, 0.1).count() == 20
    assert select.coreset(rows, 5, 3).count() == int(2 * 4 * 3)


def test_two_models(spark):
    rows, x, y = dense(spark)
    a, b = models.two_models(rows.withColumn("label2", 1 - F.col("label")), 5, 3)
    assert np.allclose(a, -b, atol=1e-9)


def test_libsvm_and_models(spark, tmp_path):
    p = tmp_path / "a.svm"
    p.write_text("+1 1:0.5 3:2\n-1 2:1\n")
    r = files.read_libsvm(spark, str(p)).orderBy("row_id").collect()
    assert [x["label"] for x in r] == [1.0, 0.0] and r[0]["idx"] == [1, 3] and files.libsvm_width(files.read_libsvm(spark, str(p))) == 4
    files.write_model(spark, [0.5, -1.25], str(tmp_path / "m"))
    assert files.read_model(spark, str(tmp_path / "m")) == [0.5, -1.25]


def test_points(spark, tmp_path):
    (tmp_path / "p.bin").write_bytes(struct.pack("<4f", 1, 2, 3, 4))
    assert [r["coord"] for r in files.read_point_blocks(spark, str(tmp_path / "p.bin"), 2).orderBy("at").collect()] == [[1, 2], [3, 4]]
    (tmp_path / "q.bin").write_bytes(b"123")
    with pytest.raises(Exception):
        files.read_point_blocks(spark, str(tmp_path / "q.bin"), 2).count()
    assert files.crc16(b"123456789") == 0xBB3D
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "b binary")
    assert [r["crc16"] for r in files.crc16_column(df, "b").collect()] == [0xBB3D, None]


def blobs(spark, n=300):
    rng = np.random.default_rng(2)
    mid = np.array([[0, 0], [10, 0], [0, 10]])
    x = mid[np.arange(n) % 3] + rng.normal(scale=0.3, size=(n, 2))
    return spark.createDataFrame([(i, 1.0, [float(a) for a in v]) for i, v in enumerate(x)], "pid long, weight float, coord array<float>")


def test_kmedian(spark, tmp_path):
    pts = blobs(spark)
    c = kmedian.kmedian(pts, 2, 3, 3, chunk_rows=100).collect()
    assert sum(r["weight"] for r in c) == pytest.approx(300) and len(c) == 3
    assert {tuple(np.round(np.array(r["coord"]) / 10)) for r in c} == {(0, 0), (1, 0), (0, 1)}
    pts.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pid long, weight float, coord array<float>").parquet(str(tmp_path / "in"))
    s = kmedian.MedianStream(spark, str(tmp_path / "state"), 2, 3, 3)
    assert s.run(stream, str(tmp_path / "cp")).agg(F.sum("weight")).first()[0] == pytest.approx(300)


def test_kmedian_bad_points(spark):
    pts = spark.createDataFrame([(1, 1.0, [1.0, 2.0]), (2, None, [3.0, 4.0]), (3, -1.0, [3.0, 4.0]), (4, 1.0, [None, 2.0]), (5, 1.0, None), (6, float("nan"), [1.0, 1.0])], "pid long, weight float, coord array<float>")
    assert kmedian.kmedian(pts, 2, 1, 5).agg(F.sum("weight")).first()[0] == 2.0
    assert kmedian.kmedian(pts.limit(0), 2, 1, 5).count() == 0


def test_unique_and_combine(spark):
    a = spark.createDataFrame([(0, 1.0), (1, None), (2, 1.0)], "idx long, value double")
    assert sorted((r["value"] is None, r["value"]) for r in arrays.unique(a).collect()) == [(False, 1.0), (True, None)]
    b = spark.createDataFrame([(0, 5.0), (1, 2.0), (9, 3.0)], "idx long, value double")
    assert {r["idx"]: r["value"] for r in arrays.combine(a, b).collect()} == {0: 6.0, 1: 2.0, 2: 1.0, 9: 3.0}
    assert {r["idx"]: r["value"] for r in arrays.combine(a, b, "max").collect()}[0] == 5.0


def test_run_statistics(spark):
    log = spark.createDataFrame([(1, "a", 9.0, 10, True), (2, "a", 2.0, 10, True), (3, "a", 4.0, 10, True), (4, "a", None, 10, True), (5, "a", 1.0, 10, False), (6, "b", 1.0, 1, True)], "run long, kind string, s double, w long, fine boolean")
    r = {x["kind"]: x for x in scans.run_statistics(log, ["kind"], "s", "w", "fine", "run").collect()}
    assert set(r) == {"a"} and (r["a"]["runs"], r["a"]["done"], r["a"]["failed"], r["a"]["mean_s"]) == (4, 3, 1, 3.0)
    assert r["a"]["rate"] == pytest.approx(2 / (0.2 + 0.4))


def test_prefix_scan_and_consecutive_reads(spark):
    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "a int, b int, v string")
    assert {r["v"] for r in scans.prefix_scan(t, {"a": 1}).collect()} == {"a", "b"}
    keys = spark.createDataFrame([(k, k * k) for k in (1, 2, 4, 9)], "k long, v long")
    asked = spark.createDataFrame([(1, 1), (2, 8)], "txn int, first long")
    got = scans.consecutive_reads(keys, asked, "k", "first", 4).collect()
    assert {(r["txn"], r["k"], r["v"]) for r in got} == {(1, 1, 1), (1, 2, 4), (1, 4, 16), (2, 9, 81)}


def test_first_crossing(spark):
    import random

    rng = random.Random(1)
    ticks = [(s, rng.choice("AB"), float(rng.randrange(20))) for s in range(60)]
    asked = [(i, rng.choice("ABC"), float(rng.randrange(-2, 22))) for i in range(40)] + [(99, "A", None)]
    t = spark.createDataFrame([*ticks, (60, "A", None)], "seq long, symbol string, price double")
    r = spark.createDataFrame(asked, "id long, symbol string, bid double")
    for rising in (False, True):
        got = {x["id"]: x["hit"] for x in scans.first_crossing(r, t, "symbol", "bid", "price", "seq", rising).collect()}
        want = {i: min((s for s, k, p in ticks if k == c and b is not None and (p >= b if rising else p <= b)), default=None) for i, c, b in asked}
        assert got == want


def test_flat_files_and_edge_parts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 2.5)], "k int, s string, x double")
    files.write_flat(rows, str(tmp_path / "f"))
    assert sorted(map(tuple, files.read_flat(spark, str(tmp_path / "f"), rows.schema).collect())) == [(1, "a", None), (2, None, 2.5)]
    edges = spark.range(40).selectExpr("id as src", "id + 1 as dst").repartition(4)
    files.write_edges(edges, str(tmp_path / "e"), single=False)
    parts = sorted((tmp_path / "e").glob("part-*"))
    lines = "".join(p.read_text() for p in parts).splitlines()
    assert len(parts) > 2 and lines[0] == "41 40" and sorted(lines[1:]) == sorted(f"{k} {k + 1}" for k in range(40))


def test_point_files_are_read_in_ranges(spark, tmp_path):
    x = np.arange(60, dtype="<f4").reshape(30, 2)
    (tmp_path / "p.bin").write_bytes(x.tobytes())
    (tmp_path / "q.bin").write_bytes(b"")
    got = files.read_point_blocks(spark, str(tmp_path), 2, chunk_points=7).orderBy("at").collect()
    assert [r["at"] for r in got] == list(range(30)) and [r["coord"] for r in got] == x.tolist()


def test_medians_stay_within_their_bounds():
    from quarry.streaming import kmedian

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, 3)) for c in rng.normal(size=(7, 3)) * 5])
    for low, high in ((7, 7), (2, 3), (20, 25)):
        got = kmedian.search(np.ones(len(x)), x, low, high)
        assert low <= len(got) <= high and all((x == g).all(1).any() for g in got)
    seven = kmedian.search(np.ones(len(x)), x, 7, 7)
    assert kmedian._sq(x, seven).min(1).max() < 1
    d = kmedian._sq(x, x)
    assert len(kmedian.speedy_opening(d, 1e12, rng.random(len(x)))) < 5 and len(kmedian.speedy_opening(d, 1e-9, rng.random(len(x)) * 0.5)) == len(x)
