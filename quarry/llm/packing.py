"""Filling containers of fixed capacity with documents.

Items are packed best-fit decreasing inside partitions. A dual-feasible-function lower bound
certifies each partition: if it used no more bins than the bound over its own items, nothing can be
gained there. Partitions with a gap give up the items of their badly filled bins, exchange them in
ever larger groups and are packed again; what a round cannot improve stays as it is. Items above
the capacity are cut into full containers and a remainder. ``certificate`` holds the whole packing
against the bound over all pieces, whose sizes it counts (capacity kinds of size at most).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import Scratch

#: Folder of the vocabulary files; ``token_counts`` also takes a path.
TOKENIZER_FOLDER = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")
#: Items that one task packs at most in one round.
ITEMS_PER_TASK = 50_000
#: Exchanges after which open bins are closed as they are, in all partitions that are left.
MAX_ROUNDS = 12


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, id_col: str, text_col: str, vocabulary: str = f"{TOKENIZER_FOLDER}/byte_bpe_50k.tiktoken", pattern: str = PATTERN) -> DataFrame:
    """Columns ``id, size``: tokens of every text. Null ids and null texts are left out; '' has size 0."""

    def run(batches):
        enc = _encoder(vocabulary, pattern)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("id"), pa.array(sizes, pa.int64())], names=["id", "size"])

    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, "id long, size long")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item; sizes must lie in 1..capacity.

    Open bins are kept by free space; the set of free spaces in use is one big integer, so the
    tightest bin that fits is found by its lowest bit at or above the item's size.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    by_free: dict[int, list[int]] = {}
    in_use, bins = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = in_use >> s
        if fit:
            free = s + (fit & -fit).bit_length() - 1
            stack = by_free[free]
            b = stack.pop()
            if not stack:
                in_use ^= 1 << free
                del by_free[free]
        else:
            b, free, bins = bins, capacity, bins + 1
        out[i] = b
        left = free - s
        if left:
            if left in by_free:
                by_free[left].append(b)
            else:
                by_free[left] = [b]
                in_use |= 1 << left
    return out


def dff_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Lower bound on the bins: the best of two families of dual feasible functions.

    u_k(x) keeps multiples of 1/(k+1) and rounds the rest by k; the threshold family drops items
    below e and lifts items above 1 - e to a whole bin. A dual feasible function maps any set that
    fits one bin to a sum of at most 1, so the mapped total is a valid bound. With ``counts`` the
    sizes are distinct and occur that often.
    """
    if not len(sizes):
        return 0
    values, counts = np.unique(sizes, return_counts=True) if counts is None else (sizes, counts)
    total = int((values * counts).sum())
    best = -(-total // capacity)
    for k in range(1, 13):
        prod = values * (k + 1)
        whole = prod % capacity == 0
        # k * u_k in integers: multiples map to x * k, the rest to floor((k + 1) x)
        mapped = int((counts[whole] * values[whole] * k).sum()) + capacity * int((counts[~whole] * (prod[~whole] // capacity)).sum())
        best = max(best, -(-mapped // (k * capacity)))
    small = values[values <= capacity // 2]
    picks = small if len(small) <= 64 else small[np.linspace(0, len(small) - 1, 64).astype(int)]
    for e in picks.tolist():
        big = values > capacity - e
        mid = (values >= e) & ~big
        best = max(best, int(counts[big].sum()) + -(-int((values[mid] * counts[mid]).sum()) // capacity))
    return best


_DDL = "id long, piece int, size long, part long, bin long, kept boolean, bound long"
_SCHEMA = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("size", pa.int64()), ("part", pa.int64()), ("bin", pa.int64()), ("kept", pa.bool_()), ("bound", pa.int64())])


def _pack_group(t: pa.Table, capacity: int, last: bool) -> pa.Table:
    sizes = t.column("size").to_numpy()
    order = np.lexsort((t.column("piece").to_numpy(), t.column("id").to_numpy()))
    t = t.take(pa.array(order))
    sizes = sizes[order]
    bins = best_fit_decreasing(sizes, capacity)
    n = int(bins.max()) + 1
    # Whole bins came here in an exchange; if packing them anew saves none, they stay as they were.
    _, part_code = np.unique(t.column("old_part").to_numpy(), return_inverse=True)
    old = np.unique(part_code * (1 << 40) + t.column("old_bin").to_numpy(), return_inverse=True)[1]
    if t.column("old_bin")[0].as_py() >= 0 and int(old.max()) + 1 <= n:
        bins, n = old, int(old.max()) + 1
    bound = dff_bound(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=n)
    kept = np.ones(n, bool)
    gap = n - bound
    if gap and not last:
        # Give up the badly filled bins: those whose free space makes up the gap, and as many again
        # of the next ones, so that the exchange has something to fill them with.
        worst = np.argsort(fill, kind="stable")
        free = np.cumsum(capacity - fill[worst])
        k = int(np.searchsorted(free, gap * capacity)) + 1
        kept[worst[: min(n, 2 * k + 1)]] = False
    elif not last:
        # Certified, but its last bin may still be open: the remainder of all partitions is shared.
        loose = np.flatnonzero(fill < capacity * 0.98)
        kept[loose[np.argsort(fill[loose])[:2]]] = False
    return pa.table([t.column("id"), t.column("piece"), t.column("size"), t.column("part"), pa.array(bins), pa.array(kept[bins]), pa.array(np.full(len(bins), bound))], schema=_SCHEMA)


def _packer(capacity: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _pack_group(t, capacity, last)


def pack(sizes: DataFrame, capacity: int, scratch: Scratch | None = None, items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """Columns ``container, id, piece, size``: every piece of every item in exactly one container.

    ``sizes(id, size)`` names each item once; sizes of zero or less take no space and are left out.
    An item is in one piece unless it exceeds the capacity; then pieces 0..n-1 are full and the last
    holds the remainder.
    """
    spark = sizes.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    src = scratch.write(sizes.where("size > 0").select(F.col("id").cast("long").alias("id"), F.col("size").cast("long").alias("size")))
    whole = F.floor(F.col("size") / capacity)
    full = src.where(F.col("size") > capacity).select("id", F.explode(F.sequence(F.lit(0), (whole - 1).cast("int"))).alias("piece"), F.lit(capacity).cast("long").alias("size"))
    rest = src.select("id", F.when(F.col("size") > capacity, whole).otherwise(0).cast("int").alias("piece"), F.when(F.col("size") > capacity, F.col("size") % capacity).otherwise(F.col("size")).cast("long").alias("size")).where("size > 0")
    n = src.count()
    parts = max(1, -(-n // items_per_task), min(8, n // 2_000))
    none = F.lit(-1).cast("long")
    work = rest.select("id", "piece", "size", F.pmod(F.xxhash64("id", "piece"), F.lit(parts)).cast("long").alias("part"), none.alias("old_part"), none.alias("old_bin"))
    closed: list[DataFrame] = []
    level = 0
    while True:
        last = parts == 1 or level == MAX_ROUNDS
        packed = scratch.write(work.groupBy("part").applyInArrow(_packer(capacity, last), _DDL))
        closed.append(packed.where("kept").select("id", "piece", "size", F.lit(level).alias("level"), "part", "bin"))
        if last:
            break
        opened = packed.where("not kept")
        n = opened.count()
        if not n:
            break
        # The exchange: open bins of several partitions meet in one, hashed anew each round.
        parts = -(-n // items_per_task)
        level += 1
        work = opened.select("id", "piece", "size", F.pmod(F.xxhash64("part", "bin", F.lit(level)), F.lit(parts)).cast("long").alias("part"), F.col("part").alias("old_part"), F.col("bin").alias("old_bin"))
    done = closed[0]
    for x in closed[1:]:
        done = done.unionByName(x)
    done = done.unionByName(full.select("id", "piece", "size", F.lit(-1).alias("level"), F.col("id").alias("part"), F.col("piece").cast("long").alias("bin")))
    return done.select(F.concat_ws("-", "level", "part", "bin").alias("container"), "id", "piece", "size")


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """One row per container: ``container, items, used, unused, documents`` (ids in order)."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("used"), F.sort_array(F.collect_list("id")).alias("documents")).select("container", "items", "used", (F.lit(capacity) - F.col("used")).alias("unused"), "documents")


def cut_items(packed: DataFrame) -> DataFrame:
    """Ids that the packing had to cut."""
    return packed.groupBy("id").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1").select("id")


def certificate(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """Containers used and the dual-feasible bound over the whole input.

    What comes to the driver is the number of pieces per size, ``capacity`` rows at most.
    """
    n = packed.agg(F.countDistinct("container").alias("n")).first()["n"]
    t = packed.groupBy("size").agg(F.count(F.lit(1)).alias("k")).orderBy("size").toArrow()
    return n, dff_bound(t.column("size").to_numpy(), capacity, t.column("k").to_numpy())
