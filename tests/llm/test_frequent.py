import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import frequent as Q


def test_counts_are_exact_and_none_is_lost(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5) if rng.random() < 0.5 else rng.randrange(10, 5000), rng.randrange(4000)) for _ in range(8000)] + [(None, -1), (-7, None)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(40)
    got = {(r["col"], r["item"]): r["count"] for r in Q.frequent_items(df, ["a", "b"], 0.01, counters=120).collect()}
    want = {}
    for c in (0, 1):
        n = Counter(r[c] for r in rows if r[c] is not None and r[c] >= 0)
        total = sum(n.values())
        want |= {(c, k): v for k, v in n.items() if v >= 0.01 * total}
    assert got == want


@pytest.mark.parametrize("parts", [1, 4])
def test_counters_and_errors_bound_the_true_counts(parts):
    rng = np.random.default_rng(0)
    sums, true = [Q.Summary(10) for _ in range(parts)], Counter()
    for k in range(30):
        x = np.minimum(rng.zipf(1.3, 200), 500)
        true.update(x.tolist())
        sums[k % parts].add(*np.unique(x, return_counts=True))
    s = sums[0]
    for other in sums[1:]:
        s.merge(other.items, other.counts, other.errors, other.floor, other.rows)
    assert len(s.items) == 10 and s.rows == 6000
    assert s.floor <= s.rows / 10 and s.errors.max() <= s.rows / 10 and s.counts.sum() <= s.rows
    held = {i: (c, e) for i, c, e in zip(s.items.tolist(), s.counts.tolist(), s.errors.tolist())}
    for k, v in true.items():
        c, e = held.get(k, (s.floor, s.floor))
        assert c - e <= v <= c


def test_the_smallest_counter_is_replaced():
    s = Q.Summary(2)
    s.add(np.array([1, 2]), np.array([5, 3]))
    s.add(np.array([7]), np.array([1]))
    assert dict(zip(s.items.tolist(), zip(s.counts.tolist(), s.errors.tolist()))) == {1: (5, 0), 7: (4, 3)}


def test_edges(spark):
    df = spark.createDataFrame([], "a int")
    assert Q.frequent_items(df, ["a"], 0.1).count() == 0
    with pytest.raises(ValueError):
        Q.frequent_items(df, ["a"], 0.1, counters=5)
    one = spark.createDataFrame([(3,)] * 9, "a int")
    assert [tuple(r) for r in Q.frequent_items(one, ["a"], 0.5).collect()] == [(0, 3, 9, 9, 9, 0)]
