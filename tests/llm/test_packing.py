import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_bins_hold_and_bound_is_a_bound(sizes):
    s = np.array(sizes)
    bins = P.best_fit_decreasing(s, 50)
    assert np.bincount(bins, weights=s).max() <= 50
    assert P.dff_bound(s, 50) <= bins.max() + 1


def test_bound_beats_volume():
    assert P.dff_bound(np.full(10, 26), 50) == 10  # volume says 6
    assert P.dff_bound(np.full(9, 17), 50) == 5  # two fit a bin
    assert P.dff_bound(np.zeros(0, int), 50) == 0


@pytest.mark.parametrize("per_task", [50_000, 40])
def test_every_piece_once(spark, per_task):
    rng = np.random.default_rng(1)
    sizes = [(i, int(x)) for i, x in enumerate(rng.integers(1, 160, 500))] + [(900, 1000), (901, 0), (902, 100), (903, 200)]
    p = P.pack(spark.createDataFrame(sizes, "id long, size long"), 100, items_per_task=per_task)
    assert p.groupBy("container").agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= 100
    back = {r["id"]: r["s"] for r in p.groupBy("id").agg(F.sum("size").alias("s")).collect()}
    assert back == {i: s for i, s in sizes if s > 0}
    assert p.groupBy("id", "piece").count().where("count > 1").count() == 0
    assert {r["id"] for r in P.cut_items(p).collect()} == {i for i, s in sizes if s > 100}
    used, bound = P.certificate(p, 100)
    assert bound <= used <= 1.1 * bound


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "id long, size long"), 10).count() == 0


def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|> " * 3), (5, "word " * 20000)], "doc_id long, text string")
    got = {r["id"]: r["size"] for r in P.token_counts(docs, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == 0 and set(got) == {1, 2, 4, 5} and got[5] >= 20000
    p = P.containers(P.pack(P.token_counts(docs, "doc_id", "text"), 4096), 4096)
    assert p.agg(F.sum("used")).first()[0] == sum(got.values())
