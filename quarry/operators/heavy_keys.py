"""Per-key results when a few keys hold most rows.

Dense accumulator arrays: every input split dictionary-encodes its own keys and counts with
``numpy.bincount`` over the codes, so a hot key costs a split one accumulator cell however many
rows it has. The cells leave the split as array blocks, addressed by a hash of the whole cell
(key and value), and the blocks are summed by a distributed reduction. No task ever sees the rows
of one key together, so no key can slow one down.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import row_bytes_estimate

#: Cells that one block holds about; three arrays of 8 bytes each.
BLOCK_CELLS = 400_000


def dictionary_encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the code of every row."""
    dictionary, codes = np.unique(values, return_inverse=True)
    return dictionary, codes.reshape(-1)


def _cells(k: np.ndarray, v: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum the weights ``n`` (1 if none) of equal (k, v) cells."""
    kd, kc = dictionary_encode(k)
    vd, vc = dictionary_encode(v)
    cell = kc.astype(np.int64) * len(vd) + vc
    if len(kd) * len(vd) <= 4 * len(k):
        dense = np.bincount(cell, minlength=len(kd) * len(vd)) if n is None else _scatter_sum(cell, n, len(kd) * len(vd))
        at = np.flatnonzero(dense)
        return kd[at // len(vd)], vd[at % len(vd)], dense[at]
    used, codes = dictionary_encode(cell)
    total = np.bincount(codes, minlength=len(used)) if n is None else _scatter_sum(codes, n, len(used))
    return kd[used // len(vd)], vd[used % len(vd)], total


def _scatter_sum(codes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, weights.dtype)
    np.add.at(out, codes, weights)
    return out


def _mix(k: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit mixing hash of two integer columns."""
    with np.errstate(over="ignore"):
        x = k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _lists(block: np.ndarray, n_blocks: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Array blocks: the columns' values of each non-empty block as one list per column."""
    order = np.argsort(block, kind="stable")
    counts = np.bincount(block, minlength=n_blocks)
    ids = np.flatnonzero(counts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts[ids])]).astype(np.int32))
    return ids, [pa.ListArray.from_arrays(offsets, pa.array(c[order])) for c in columns]


def _block_count(df: DataFrame, per_block: int) -> int:
    """Blocks from the plan's size, or from a count where the plan has none (in-memory rows)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = row_bytes_estimate(df)
    rows = size // 24 if size < 1 << 50 else df.count()
    return max(parts, rows // per_block + 1)


def key_mode(df: DataFrame, key: str, value: str, min_rows: int = 1, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Per key its row count, its most frequent value (of equals the smallest) and that value's count.

    Both columns must be integers. Rows where either is null are skipped; keys with fewer than
    ``min_rows`` rows are left out. Columns out: ``key LONG, n LONG, value LONG, value_n LONG``.
    """
    pairs = df.select(F.col(key).cast("long").alias("k"), F.col(value).cast("long").alias("v")).where("k is not null and v is not null")
    n_blocks = _block_count(pairs, block_cells)
    schema = pa.schema([("block", pa.int32()), ("k", pa.list_(pa.int64())), ("v", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])

    def split(batches):
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 1_000_000:
                yield emit(held)
                held, rows = [], 0
        if rows:
            yield emit(held)

    def emit(held):
        t = pa.Table.from_batches(held)
        k, v, n = _cells(t.column("k").to_numpy(), t.column("v").to_numpy())
        ids, lists = _lists((_mix(k, v) % np.uint64(n_blocks)).astype(np.int64), n_blocks, [k, v, n.astype(np.int64)])
        return pa.record_batch([pa.array(ids.astype(np.int32)), *lists], schema=schema)

    def reduce_block(t: pa.Table) -> pa.Table:
        k, v, n = (pa.concat_arrays([c.flatten() for c in t.column(x).chunks]).to_numpy() for x in ("k", "v", "n"))
        k, v, n = _cells(k, v, n)
        order = np.lexsort((v, -n, k))
        k, v, n = k[order], v[order], n[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        return pa.table({"k": k[first], "n": np.add.reduceat(n, first) if len(k) else n, "v": v[first], "vn": n[first]})

    blocks = pairs.mapInArrow(split, "block int, k array<long>, v array<long>, n array<long>")
    part = blocks.groupBy("block").applyInArrow(reduce_block, "k long, n long, v long, vn long")
    best = F.max(F.struct(F.col("vn"), (-F.col("v")).alias("neg")))
    return (
        part.groupBy("k")
        .agg(F.sum("n").alias("n"), best.alias("b"))
        .where(F.col("n") >= min_rows)
        .select(F.col("k").alias("key"), "n", (-F.col("b.neg")).alias("value"), F.col("b.vn").alias("value_n"))
    )


def key_stats(df: DataFrame, key: str, measure: str, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Per key the row count, and count, sum, minimum and maximum of an integer measure.

    A null key is skipped; a null measure counts as a row only. Columns out: ``key, n, measured,
    total, low, high`` (all LONG; the last three null where nothing was measured).
    """
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(measure).cast("long").alias("m")).where("k is not null")
    n_blocks = _block_count(rows, block_cells)
    names = ["k", "n", "c", "s", "lo", "hi"]
    schema = pa.schema([("block", pa.int32()), *((x, pa.list_(pa.int64())) for x in names)])
    big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def split(batches):
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column("m")
            ok = ~np.asarray(m.is_null())
            x = np.asarray(m.fill_null(0))
            kd, kc = dictionary_encode(b.column("k").to_numpy())
            n, c = np.bincount(kc, minlength=len(kd)), np.bincount(kc[ok], minlength=len(kd))
            s = _scatter_sum(kc[ok], x[ok], len(kd))
            lo, hi = np.full(len(kd), big), np.full(len(kd), small)
            np.minimum.at(lo, kc[ok], x[ok])
            np.maximum.at(hi, kc[ok], x[ok])
            ids, lists = _lists((_mix(kd, np.zeros_like(kd)) % np.uint64(n_blocks)).astype(np.int64), n_blocks, [kd, n, c, s, lo, hi])
            yield pa.record_batch([pa.array(ids.astype(np.int32)), *lists], schema=schema)

    def reduce_block(t: pa.Table) -> pa.Table:
        k, n, c, s, lo, hi = (pa.concat_arrays([x.flatten() for x in t.column(y).chunks]).to_numpy() for y in names)
        kd, kc = dictionary_encode(k)
        low, high = np.full(len(kd), big), np.full(len(kd), small)
        np.minimum.at(low, kc, lo)
        np.maximum.at(high, kc, hi)
        cnt = _scatter_sum(kc, c, len(kd))
        none = cnt == 0
        return pa.table({"key": kd, "n": _scatter_sum(kc, n, len(kd)), "measured": cnt, "total": pa.array(_scatter_sum(kc, s, len(kd)), mask=none), "low": pa.array(low, mask=none), "high": pa.array(high, mask=none)})

    lists_ddl = ", ".join(f"{x} array<long>" for x in names)
    blocks = rows.mapInArrow(split, f"block int, {lists_ddl}")
    return blocks.groupBy("block").applyInArrow(reduce_block, "key long, n long, measured long, total long, low long, high long")
