"""Indexed arrays: a global array is ``DataFrame(idx LONG, value)``; ownership is its partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _logical(c: Column) -> Column:
    return (c != 0).cast("int")


#: Reductions by name; the logical ones treat any non-zero value as true and give 0 or 1.
REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "add": F.sum,
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "prod": F.product,
    "mult": F.product,
    "or": F.bit_or,
    "bor": F.bit_or,
    "lor": lambda c: F.bool_or(c != 0).cast("int"),
    "and": F.bit_and,
    "band": F.bit_and,
    "land": lambda c: F.bool_and(c != 0).cast("int"),
    "xor": F.bit_xor,
    "bxor": F.bit_xor,
    "lxor": lambda c: F.bit_xor(_logical(c)),
}


def fill(array: DataFrame, value, value_col: str = "value") -> DataFrame:
    """Every element set to one constant."""
    return array.withColumn(value_col, F.lit(value).cast(array.schema[value_col].dataType))


def map_elements(array: DataFrame, fn: Callable[[Column], Column] | Callable[[Column, Column], Column], indexed: bool = False, value_col: str = "value") -> DataFrame:
    """fn(value) or, with ``indexed``, fn(idx, value) on every element."""
    v = F.col(value_col)
    return array.withColumn(value_col, fn(F.col("idx"), v) if indexed else fn(v))


def map_blocks(array: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """fn(pandas frame) on every local block of a partition, for work no expression can state."""
    return array.mapInPandas(lambda frames: (fn(f) for f in frames), ddl)


def reduce_array(array: DataFrame, op: str, value_col: str = "value") -> DataFrame:
    """One row ``value``: partial results per task, folded once. Nulls are ignored; empty gives null."""
    return array.agg(REDUCTIONS[op](F.col(value_col)).alias("value"))


def allreduce(array: DataFrame, op: str, value_col: str = "value", out: str = "total") -> DataFrame:
    """The reduction beside every element, as a scalar subquery."""
    total = array.agg(REDUCTIONS[op](F.col(value_col)).alias(out))
    return array.withColumn(out, total.scalar())


def scatter_update(array: DataFrame, updates: DataFrame, op: str = "xor", value_col: str = "value") -> DataFrame:
    """``A[idx] op= value`` for every update row ``(idx, value)``; updates outside the array are dropped.

    Updates combine map-side, so a hot index costs a row per task.
    """
    by_idx = updates.groupBy("idx").agg(REDUCTIONS[op](F.col(value_col)).alias("__u"))
    v, u = F.col(value_col), F.col("__u")
    combine = {"xor": v.bitwiseXOR(u), "bxor": v.bitwiseXOR(u), "or": v.bitwiseOR(u), "bor": v.bitwiseOR(u), "and": v.bitwiseAND(u), "band": v.bitwiseAND(u), "add": v + u, "sum": v + u, "max": F.greatest(v, u), "min": F.least(v, u), "prod": v * u, "mult": v * u}[op]
    return array.join(by_idx, "idx", "left").withColumn(value_col, F.when(u.isNull(), v).otherwise(combine)).drop("__u")


def read_elements(array: DataFrame, wanted: DataFrame) -> DataFrame:
    """Values at the wanted ``idx``; an index outside the array gives null."""
    return wanted.join(array, "idx", "left")


def write_elements(array: DataFrame, writes: DataFrame, value_col: str = "value") -> DataFrame:
    """Elements replaced by ``writes(idx, value)``; of several writes to one index the largest value stays."""
    last = writes.groupBy("idx").agg(F.max(value_col).alias("__w"))
    return array.join(last, "idx", "left").withColumn(value_col, F.coalesce("__w", value_col)).drop("__w")


def unique(array: DataFrame) -> DataFrame:
    """Distinct values of an array, nulls included once."""
    return array.select("value").distinct()


def combine(a: DataFrame, b: DataFrame, op: str = "add") -> DataFrame:
    """Element by element ``a op b`` by index (add, mul, min, max); a cell that one side lacks stays as it is."""
    x, y = F.col("value"), F.col("other")
    both = {"add": x + y, "mul": x * y, "min": F.least(x, y), "max": F.greatest(x, y)}[op]
    j = a.select("idx", "value").join(b.select("idx", F.col("value").alias("other")), "idx", "full")
    return j.select("idx", F.coalesce(both, "value", "other").alias("value"))
