"""Most frequent items in bounded memory.

Space-saving summaries: a partition keeps at most ``counters`` items, each with a count that is never
too low and the error by which it may be too high. A new item takes the place of the smallest
counter and inherits its count as its error. Batches and partial summaries merge by the same rule:
an item that only one side holds may have had the other side's smallest count there, so that much
is added to its count and to its error, and the largest counts stay. Summaries merge in a tree of
bounded fan-in; no error exceeds rows / counters at any level, so an item that is frequent enough
cannot be lost. A second pass counts the surviving candidates exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import Scratch, broadcast_if_small

_SCHEMA = pa.schema([("col", pa.int32()), ("items", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("errors", pa.list_(pa.int64())), ("rows", pa.int64())])
_DDL = "col int, items array<long>, counts array<long>, errors array<long>, rows long"
FAN_IN = 16


class Summary:
    """At most ``size`` counters: the true count of a held item lies in [count - error, count], that of
    any other item is at most ``floor``."""

    def __init__(self, size: int):
        self.size, self.rows = size, 0
        self.items, self.counts, self.errors = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def floor(self) -> int:
        return int(self.counts.min()) if len(self.items) >= self.size else 0

    def merge(self, items: np.ndarray, counts: np.ndarray, errors: np.ndarray, floor: int, rows: int) -> None:
        """Takes in distinct items with their counters; ``floor`` bounds what the other side left out."""
        mine = self.floor
        every, at = np.unique(np.concatenate([self.items, items]), return_inverse=True)
        at = at.reshape(-1)
        a, b = at[: len(self.items)], at[len(self.items) :]
        count, error = np.zeros((2, len(every)), np.int64), np.zeros((2, len(every)), np.int64)
        count[0], error[0], count[1], error[1] = mine, mine, floor, floor
        count[0, a], error[0, a], count[1, b], error[1, b] = self.counts, self.errors, counts, errors
        self.items, self.counts, self.errors = every, count.sum(0), error.sum(0)
        self.rows += rows
        if len(every) > self.size:
            keep = np.sort(np.argpartition(-self.counts, self.size - 1)[: self.size])
            self.items, self.counts, self.errors = self.items[keep], self.counts[keep], self.errors[keep]

    def add(self, items: np.ndarray, counts: np.ndarray) -> None:
        """Takes in exact counts of distinct items."""
        self.merge(items, counts, np.zeros(len(items), np.int64), 0, int(counts.sum()))

    def batch(self, col: int) -> pa.RecordBatch:
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (self.items, self.counts, self.errors)]
        return pa.record_batch([pa.array([col], pa.int32()), *lists, pa.array([self.rows])], schema=_SCHEMA)


def frequent_items(df: DataFrame, columns: list[str], share: float, counters: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Items that hold at least ``share`` of a column's valid rows: ``col, item, count, rows, estimate, error``.

    ``count`` is exact, from the second pass; the summary's estimate lies between it and count + error.

    ``columns`` are integer columns; ``col`` is their position. Rows where a column is null or
    negative are not valid for it. The summary needs ``counters`` > 1 / share (default ten times
    that); its size, and the number of candidates, is bounded by it whatever the data.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "frequent")
    size = counters or int(np.ceil(10 / share))
    if size * share <= 1:
        raise ValueError("too few counters for this share")

    def summarise(batches):
        sums = [Summary(size) for _ in columns]
        held: list[list[np.ndarray]] = [[] for _ in columns]
        n = 0
        for b in batches:
            n += b.num_rows
            for i, c in enumerate(columns):
                a = b.column(i)
                held[i].append(a.drop_null().to_numpy(zero_copy_only=False))
            if n >= 200_000:
                flush(sums, held)
                n = 0
        flush(sums, held)
        for i, s in enumerate(sums):
            yield s.batch(i)

    def flush(sums, held):
        for s, parts in zip(sums, held):
            if parts:
                x = np.concatenate(parts)
                s.add(*np.unique(x[x >= 0], return_counts=True))
                parts.clear()

    def merge(t: pa.Table) -> pa.Table:
        s = Summary(size)
        for items, counts, errors, rows in zip(*(t.column(c).to_pylist() for c in ("items", "counts", "errors", "rows"))):
            s.merge(np.array(items, np.int64), np.array(counts, np.int64), np.array(errors, np.int64), min(counts) if len(items) >= size else 0, rows)
        return pa.Table.from_batches([s.batch(t.column("col")[0].as_py())])

    data = df.select(*[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(columns)])
    level = scratch.write(data.mapInArrow(summarise, _DDL))
    n = level.count() // max(1, len(columns))
    while n > 1:
        groups = -(-n // FAN_IN)
        spread = level.withColumn("grp", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        merged = spread.groupBy("col", "grp").applyInArrow(lambda t: merge(t.drop_columns(["grp"])), _DDL)
        new = scratch.write(merged)
        scratch.drop(level)
        level, n = new, groups
    # One summary per column: at most len(columns) * size candidates.
    cand = level.select("col", "rows", F.explode(F.arrays_zip("items", "counts", "errors")).alias("x")).where(F.col("x.counts") >= F.col("rows") * share)
    cand = scratch.write(cand.select("col", F.col("x.items").alias("item"), F.col("x.counts").alias("estimate"), F.col("x.errors").alias("error"), "rows"))
    long = data.select(F.posexplode(F.array(*data.columns)).alias("col", "item"))
    exact = long.join(broadcast_if_small(cand), ["col", "item"]).groupBy("col", "item").agg(F.count(F.lit(1)).alias("count"), *[F.max(c).alias(c) for c in ("rows", "estimate", "error")])
    return exact.where(F.col("count") >= F.col("rows") * share)
