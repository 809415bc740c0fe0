import random
from collections import Counter, defaultdict

import pytest

from quarry.operators import heavy_keys as K


def brute_mode(rows, least):
    by = defaultdict(Counter)
    for k, v in rows:
        if k is not None and v is not None:
            by[k][v] += 1
    out = set()
    for k, c in by.items():
        n = sum(c.values())
        if n >= least:
            v, m = min(c.items(), key=lambda x: (-x[1], x[0]))
            out.add((k, n, v, m))
    return out


@pytest.mark.parametrize("cells", [4, 400_000])
def test_mode_with_a_hot_key(spark, cells):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(60), rng.randrange(12)) for _ in range(3000)] + [(None, 1), (1, None), (-5, 7), (-5, 7)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "k long, v int, n string")
    got = {tuple(r) for r in K.key_mode(df, "k", "v", 2, cells).collect()}
    assert got == brute_mode(rows, 2)


def test_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, 9), (1, 3), (1, 3), (1, 9)], "k int, v int")
    assert [tuple(r) for r in K.key_mode(df, "k", "v").collect()] == [(1, 4, 3, 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v int")
    assert K.key_mode(df, "k", "v").count() == 0
    assert K.key_stats(df, "k", "v").count() == 0


def test_stats(spark):
    rows = [(1, 5), (1, None), (2, None), (1, -3), (None, 4)]
    df = spark.createDataFrame(rows, "k int, v long")
    got = sorted(tuple(r) for r in K.key_stats(df, "k", "v").collect())
    assert got == [(1, 3, 2, 2, -3, 5), (2, 1, 0, None, None, None)]
