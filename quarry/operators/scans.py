"""Keyed tables: lookups, range scans, version views and record changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import broadcast_if_small


def _after(keys: list[str], bound: list, inclusive: bool) -> Column:
    """Lexicographic key > bound (>= if inclusive)."""
    out = F.lit(inclusive)
    for k, b in reversed(list(zip(keys, bound))):
        out = (F.col(k) > F.lit(b)) | ((F.col(k) == F.lit(b)) & out)
    return out


def range_scan(table: DataFrame, keys: list[str], start: list, end: list | None = None, limit: int | None = None) -> DataFrame:
    """Keys in [start, end) ascending; the end is exclusive, none is open. First key columns are also
    bounded plainly, so that files are pruned."""
    cond = _after(keys, start, True) & (F.col(keys[0]) >= F.lit(start[0]))
    if end is not None:
        cond = cond & ~_after(keys, end, True) & (F.col(keys[0]) <= F.lit(end[0]))
    out = table.where(cond).orderBy(*keys)
    return out.limit(limit) if limit else out


def reverse_scan(table: DataFrame, keys: list[str], start: list, end: list | None = None, limit: int | None = None) -> DataFrame:
    """Keys in (end, start] descending."""
    cond = ~_after(keys, start, False) & (F.col(keys[0]) <= F.lit(start[0]))
    if end is not None:
        cond = cond & _after(keys, end, False) & (F.col(keys[0]) >= F.lit(end[0]))
    out = table.where(cond).orderBy(*[F.desc(k) for k in keys])
    return out.limit(limit) if limit else out


def prefix_scan(table: DataFrame, prefix: dict) -> DataFrame:
    """Rows whose leading key columns equal the prefix."""
    return table.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in prefix.items()], F.lit(True)))


def point_lookup(table: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests with their record and ``found``; a missing key leaves the record null."""
    return requests.join(table.withColumn("found", F.lit(True)), keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def multi_lookup(table: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """All records of each requested non-unique key; missing keys give no row."""
    return requests.join(table, keys)


def as_of(versions: DataFrame, keys: list[str], at: str, when, deleted: str | None = None) -> DataFrame:
    """The newest version per key with commit time <= ``when``; keys whose newest is a deletion vanish.

    Versions that tie in time are ordered by the rest of their columns, so the choice is stable. A
    version without a time is never visible.
    """
    rest = [c for c in versions.columns if c not in keys and c != at]
    top = versions.where(F.col(at) <= F.lit(when)).groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("__v"))
    out = top.select(*keys, "__v.*")
    return out.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else out


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changed keys replace or extend the table; one change per key is expected."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def remove(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not taken are added; others are left out, as a unique index does."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh)


def first_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per group; Spark cuts each partition to n per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def median_row(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Row ceil(n / 2) (1-based) of each group in order."""
    w = Window.partitionBy(*group)
    return df.withColumn("__rn", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__rn") == F.ceil(F.col("__n") / 2)).drop("__rn", "__n")


def interval_lookup(rows: DataFrame, tiers: DataFrame, keys: list[str], value: str, low: str, high: str) -> DataFrame:
    """Joins the first tier (by ``low``) with low < value <= high among equal keys; no tier gives no row."""
    t = tiers.select(*keys, *[c for c in tiers.columns if c not in keys])
    hit = rows.withColumn("__id", F.monotonically_increasing_id()).join(broadcast_if_small(t), keys).where((F.col(low) < F.col(value)) & (F.col(value) <= F.col(high)))
    return first_per_group(hit, ["__id"], [F.col(low)]).drop("__id")


def consume_lots(lots: DataFrame, needs: DataFrame, keys: list[str], order: list[str], quantity: str, need: str, lifo: bool = False) -> DataFrame:
    """Lots with ``taken``: each key's need walks its lots in order until it is met.

    ``needs`` has one row per key. A running sum before the lot tells what is left of the need.
    """
    o = [F.desc(c) if lifo else F.asc(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    joined = lots.join(needs, keys)
    before = F.coalesce(F.sum(quantity).over(w), F.lit(0))
    taken = F.least(F.col(quantity), F.greatest(F.col(need) - before, F.lit(0)))
    return joined.withColumn("taken", taken)


def first_crossing(requests: DataFrame, ticks: DataFrame, key: str, limit: str, price: str, seq: str, rising: bool) -> DataFrame:
    """Adds ``hit``: the smallest ``seq`` of the key whose price has reached the limit (null if none).

    With ``rising`` a price of at least the limit counts, else one of at most the limit. Ticks are
    combined per price before the shuffle; then prices and limits are walked once in order with a
    running minimum, so a key with many ticks and many requests makes no pairs. Null prices and
    limits reach nothing.
    """
    first = ticks.where(F.col(price).isNotNull()).groupBy(key, F.col(price).alias("__x")).agg(F.min(seq).alias("__s"))
    asked = requests.withColumn("__x", F.col(limit))
    both = asked.withColumn("__s", F.lit(None).cast(first.schema["__s"].dataType)).withColumn("__q", F.lit(1)).unionByName(first.withColumn("__q", F.lit(0)), allowMissingColumns=True)
    order = [F.desc_nulls_last("__x") if rising else F.asc_nulls_last("__x"), F.asc("__q")]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("hit", F.when(F.col("__x").isNotNull(), F.min("__s").over(w))).where("__q = 1").select(*requests.columns, "hit")


def consecutive_reads(table: DataFrame, requests: DataFrame, key: str, start: str, count: int) -> DataFrame:
    """Every request with the records of the keys start .. start + count - 1 that exist. A request asks for
    each key by itself, so the join is an equi-join whatever the table's size."""
    asked = requests.withColumn(key, F.explode(F.sequence(F.col(start), F.col(start) + count - 1)))
    return asked.join(table, key)


def run_statistics(log: DataFrame, group: list[str], seconds: str, work: str | None = None, ok: str | None = None, skip: str | None = None) -> DataFrame:
    """Per group ``runs, done, failed, mean_s, min_s, max_s`` and with ``work`` its rate, the harmonic mean of
    work per second. Runs without a time, or with none above zero, are counted but not timed; with
    ``skip`` each group's first run (by that column) warms up and is left out."""
    t = log
    if skip:
        t = t.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(skip))).where("__n > 1")
    fine = F.coalesce(F.col(ok), F.lit(False)) if ok else F.lit(True)
    s = F.when((F.col(seconds) > 0) & fine, F.col(seconds))
    out = [F.count(F.lit(1)).alias("runs"), F.count_if(fine).alias("done"), F.count_if(~fine).alias("failed"), F.avg(s).alias("mean_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s")]
    if work:
        out.append((F.count(s / F.col(work)) / F.sum(s / F.when(F.col(work) > 0, F.col(work)))).alias("rate"))
    return t.groupBy(*group).agg(*out)
