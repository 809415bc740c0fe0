"""Vector blocks: cross-polytope hashing and exact comparison inside buckets.

Vectors are centred (per table about the mean moved by a quarter of the root-mean-square radius in
a random direction, so that points near the mean still have a stable direction), normalised and
rotated by pseudo-random rotations H D3 H D2 H D1 (H the Hadamard transform, D random signs). The
hash is the nearest signed axis. A table concatenates as many hashes as the number of vectors asks
for (``hash_widths``), the last one over the leading axes only, so that buckets keep their size
while the collection grows. Multiprobe: every vector is stored in its own bucket, and queries the
bucket reached by changing the one hash whose runner-up axis is nearest, unless that is far
(``PROBE_GAP``).

A bucket is compared exactly as matrix blocks. Buckets with more than ``cap`` stored or querying
rows are cut into parts and every pair of parts becomes a block of its own, so any bucket size is
handled exactly and no block holds more than two parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import Scratch, broadcast_if_small

#: Stored, and querying, rows that a block holds at most.
BLOCK_CAP = 8192
#: Vectors that an average bucket should hold.
BUCKET_ROWS = 256
#: Unit vectors whose runner-up axis is behind by more ask in their own bucket only.
PROBE_GAP = 0.05
#: Vectors that show which buckets are above the cap (all of them, if there are no more).
HOT_SAMPLE = 1_000_000
#: Fingerprints that a task remembers at a time, to carry one of many copies.
SEEN = 300_000
STORE, STORE_AS_QUERY, STORE_ONLY, PROBE = 0, 1, 2, 3


class Vectors:
    """The distinct valid vectors of a table, and which ids share one.

    ``rows(id, vec)`` holds packed vectors, at least one row per distinct vector; a task drops the
    copies it remembers. ``members(rep, id)`` lists every valid id under the representative of its
    vector, ``groups(rep, low, copies)`` the smallest id and the number of ids of each.
    """

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, dim: int, scratch: Scratch):
        self.dim, self.scratch, self.spark = dim, scratch, df.sparkSession
        inner = df.schema[vec_col].dataType.elementType.simpleString()
        vec = F.col(vec_col) if inner in ("float", "double") else F.col(vec_col).cast("array<double>")
        src = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
        packed = scratch.write(src.mapInArrow(lambda b: _read(b, dim), "id long, f1 long, f2 long, vec binary, n long, square double, sums array<double>"))
        self.n, self.mean, self.radius = _centre(packed, dim)
        self.rows = packed.where("vec is not null").select("id", "vec")
        ids = packed.where("id is not null").groupBy("f1", "f2", "id").agg(F.max(F.col("vec").isNotNull()).alias("held"))
        ids = scratch.write(ids)
        groups = ids.groupBy("f1", "f2").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min(F.when(F.col("held"), F.col("id"))).alias("rep"))
        groups = scratch.write(groups)
        self.groups = groups.select("rep", "low", "copies")
        self.members = scratch.write(ids.join(groups.select("f1", "f2", "rep"), ["f1", "f2"]).select("rep", "id"))


def _read(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Valid rows with a 128-bit fingerprint, packed where no copy is remembered; last the sums.

    Valid are vectors of ``dim`` finite elements that are not all zero. Null, short or long vectors
    and null ids are dropped. Minus zero counts as zero.
    """
    seen: set[bytes] = set()
    count, total, square = 0, np.zeros(dim), 0.0
    names = ["id", "f1", "f2", "vec", "n", "square", "sums"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.list_(pa.float64())]
    for b in batches:
        lists = b.column("vec")
        fits = pc.equal(pc.list_value_length(lists), dim)
        x = lists.filter(fits).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids = b.column("id").filter(fits).to_numpy()
        ok = np.isfinite(x).all(1) & (x != 0).any(1)
        x, ids = x[ok] + 0.0, ids[ok]
        if not len(x):
            continue
        raw = pack(x)
        marks = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        fresh = []
        for m in marks:
            if len(seen) >= SEEN:
                seen.clear()
            fresh.append(m not in seen)
            seen.add(m)
        f = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
        new = x[np.array(fresh)].astype(np.float64)
        count, total, square = count + len(new), total + new.sum(0), square + float((new * new).sum())
        none = [None] * len(ids)
        yield pa.record_batch([pa.array(c, k) for c, k in zip((ids, f[:, 0], f[:, 1], [r if y else None for r, y in zip(raw, fresh)], none, none, none), kinds)], names=names)
    yield pa.record_batch([pa.array([c], k) for c, k in zip((None, None, None, None, count, square, total.tolist()), kinds)], names=names)


def _centre(packed: DataFrame, dim: int) -> tuple[int, np.ndarray, float]:
    """Number, mean and root-mean-square radius of the packed vectors, from the sums of the tasks."""
    part = packed.where("sums is not null").select("n", "square", F.posexplode("sums").alias("i", "x"))
    mean, n, square = np.zeros(dim), 0, 0.0
    for r in part.groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("square").alias("q")).collect():
        n, square = r["n"], r["q"]
        mean[r["i"]] = r["x"] / max(n, 1)
    return n, mean, float(np.sqrt(max(square / max(n, 1) - mean @ mean, 1e-12)))


def hash_widths(n: int, width: int) -> list[int]:
    """Axes of each hash of a table: whole ones, and a narrower last one, for n / BUCKET_ROWS buckets,
    eight at least."""
    out, left = [], max(8.0, n / BUCKET_ROWS)
    while left > 1:
        axes = min(width, 1 << int(np.ceil(np.log2(left / 2)))) if left > 2 else 1
        out.append(axes)
        left /= 2 * axes
    return out


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1))
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


class CrossPolytope:
    """Hash functions of all tables; built from a seed, so every task has the same.

    The three Hadamard factors of a rotation are multiplied once and applied as one matrix, which for
    widths of some hundred is faster than transforming every vector three times.
    """

    def __init__(self, dim: int, mean: np.ndarray, radius: float, tables: int, axes: list[int], seed: int):
        rng = np.random.default_rng(seed)
        self.axes, self.tables = axes, tables
        width = padded(dim)
        e = rng.normal(size=(tables, dim))
        self.centres = (mean[None] - 0.25 * radius * e / np.linalg.norm(e, axis=1, keepdims=True)).astype(np.float32)
        signs = rng.choice(np.array([-1.0, 1.0]), (tables, len(axes), 3, width))
        h = _hadamard(width) / np.sqrt(width)
        self.turns = []
        for t in range(tables):
            row = []
            for k, a in enumerate(axes):
                m = np.eye(width)
                for s in signs[t, k]:
                    m = (m * s) @ h
                row.append(m[:dim, :a].astype(np.float32))
            self.turns.append(row)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own and probe bucket of every row and table, int64 [rows, tables, 2], and whether to probe."""
        n = len(x)
        out, ask = np.empty((n, self.tables, 2), np.int64), np.empty((n, self.tables), bool)
        at = np.arange(n)
        for t, turns in enumerate(self.turns):
            y = x - self.centres[t]
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-30)
            own, probe = np.zeros(n, np.int64), np.zeros(n, np.int64)
            first, second, gap = [], [], np.empty((len(turns), n), np.float32)
            for k, m in enumerate(turns):
                z = y @ m
                a = np.abs(z)
                i = a.argmax(1)
                top = a[at, i].copy()
                if a.shape[1] > 1:
                    a[at, i] = -1
                    j = a.argmax(1)
                    gap[k] = top - a[at, j]
                else:  # one axis: its other side is the runner-up
                    j, gap[k] = i, 2 * top
                w = a.shape[1]
                first.append(i + w * (z[at, i] < 0))
                second.append(j + w * (z[at, j] < 0) if w > 1 else 1 - first[-1])
            swap = gap.argmin(0)
            for k, w in enumerate(self.axes):
                own = own * (2 * w) + first[k]
                probe = probe * (2 * w) + np.where(swap == k, second[k], first[k])
            out[:, t, 0], out[:, t, 1] = own, probe
            ask[:, t] = gap.min(0) < PROBE_GAP
        return out, ask


def padded(dim: int) -> int:
    """The next power of two."""
    return 1 << max(0, dim - 1).bit_length()


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, each in the narrowest float type that holds it exactly."""
    out: list[bytes | None] = [None] * len(x)
    left = np.arange(len(x))
    for kind in (np.float16, np.float32, np.float64):
        with np.errstate(over="ignore"):
            y = x[left].astype(kind)
        ok = (y.astype(np.float64) == x[left]).all(1)
        raw, step = y[ok].tobytes(), y.itemsize * x.shape[1]
        for k, i in enumerate(left[ok]):
            out[i] = raw[k * step : (k + 1) * step]
        left = left[~ok]
        if not len(left):
            break
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """Matrix of packed rows (their length tells the type)."""
    kinds = {2 * dim: np.float16, 4 * dim: np.float32, 8 * dim: np.float64}
    sizes = {len(r) for r in rows}
    if len(sizes) == 1:
        return np.frombuffer(b"".join(rows), kinds[sizes.pop()]).reshape(-1, dim)
    return np.stack([np.frombuffer(r, kinds[len(r)]).astype(np.float64) for r in rows]) if rows else np.zeros((0, dim), np.float32)


def bucket_rows(v: Vectors, tables: int, seed: int, cap: int, copies: DataFrame | None = None) -> DataFrame:
    """Rows ``key, role, id, vec`` (packed vectors) ready to be compared key by key.

    With ``copies(id, copies)`` every row also carries its number of copies (1 where it is not named)
    and ``met``: its own and probe bucket in the tables up to that of the row, as packed longs.
    """
    dim, axes = v.dim, hash_widths(v.n, padded(v.dim))
    lsh = CrossPolytope(dim, v.mean, v.radius, tables, axes, seed)
    weighed = copies is not None

    def spread(batches, vectors: bool):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                c = b.slice(s, 4096)
                codes, ask = lsh.codes(unpack(c.column("vec").to_pylist(), dim).astype(np.float32))
                for t in range(tables):
                    asks = np.flatnonzero(ask[:, t])
                    at = np.append(np.arange(c.num_rows), asks)
                    bucket = np.append(codes[:, t, 0], codes[asks, t, 1])
                    role = np.append(np.full(c.num_rows, STORE), np.full(len(asks), PROBE)).astype(np.int8)
                    cols = [np.full(len(at), t, np.int8), bucket, role]
                    names = ["t", "b", "role"]
                    if vectors:
                        cols += [c.column(k).take(pa.array(at)) for k in (["id", "vec", "copies"] if weighed else ["id", "vec"])]
                        names += ["id", "vec", *(["copies"] if weighed else [])]
                        if weighed:
                            # a bucket that is not asked is met by nobody
                            seen = np.where(np.dstack([np.ones_like(ask), ask])[: , : t + 1], codes[:, : t + 1], -1)[at]
                            ends = np.arange(0, seen.nbytes + 1, 16 * (t + 1), dtype=np.int32)
                            cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(seen))]))
                            names.append("met")
                    yield pa.record_batch(cols, names=names)

    ddl = "t byte, b long, role byte"
    sample = max(1, v.n // HOT_SAMPLE)
    shown = v.rows.where(F.pmod(F.xxhash64("vec"), F.lit(sample)) == 0) if sample > 1 else v.rows
    most = shown.select("vec").mapInArrow(lambda x: spread(x, False), ddl).groupBy("t", "b", "role").agg((F.count(F.lit(1)) * sample).alias("n"))
    # Buckets above the cap number at most 2 * tables * n / cap.
    hot = v.scratch.write(most.groupBy("t", "b").agg(F.max("n").alias("n")).where(F.col("n") > cap).select("t", "b", F.ceil(F.col("n") / cap).cast("int").alias("nb")))
    src = v.rows
    if weighed:
        src = src.join(broadcast_if_small(copies), "id", "left").select("id", "vec", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    rows = src.mapInArrow(lambda x: spread(x, True), ddl + ", id long, vec binary" + (", copies long, met binary" if weighed else ""))
    held = ["id", "vec", *(["copies", "met"] if weighed else [])]
    key = F.xxhash64("t", "b")
    if hot.limit(1).count():
        # Copies fall into one part. A probe goes to (its part, every part); a stored row there as a
        # query, and to (every part, its own) as stored.
        rows = rows.join(broadcast_if_small(hot), ["t", "b"], "left").withColumn("i", F.pmod(F.xxhash64("vec"), F.coalesce("nb", F.lit(1))).cast("int"))
        every = F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)
        stored = F.array_distinct(F.flatten(F.transform(every, lambda j: F.array(
            F.struct(F.col("i").alias("i"), j.alias("j"), F.when(j == F.col("i"), STORE).otherwise(STORE_AS_QUERY).alias("role")),
            F.struct(F.when(j == F.col("i"), F.col("i")).otherwise(j).alias("i"), F.col("i").alias("j"), F.when(j == F.col("i"), STORE).otherwise(STORE_ONLY).alias("role")),
        ))))
        asked = F.transform(every, lambda j: F.struct(F.col("i").alias("i"), j.alias("j"), F.lit(PROBE).alias("role")))
        rows = rows.select("t", "b", *held, F.explode(F.when(F.col("role") == PROBE, asked).otherwise(stored)).alias("x")).select("t", "b", *held, "x.i", "x.j", "x.role")
        key = F.xxhash64("t", "b", "i", "j")
    # about 16 MB of packed vectors a task
    width = 2 * dim + 40 + (8 * tables + 16 if weighed else 0)
    parts = max(int(v.spark.conf.get("spark.sql.shuffle.partitions")), v.n * tables * 2 * width // (16 << 20) + 1)
    return rows.select(key.alias("key"), F.col("role").cast("byte").alias("role"), *held).repartition(parts, "key")


class Block:
    """One bucket block: stored rows, their queries, and squared distances on demand.

    Copies that several tasks carried are one row, under their smallest id.
    """

    def __init__(self, ids: np.ndarray, role: np.ndarray, rows: list[bytes], dim: int, copies: np.ndarray | None = None, met: np.ndarray | None = None):
        low: dict[bytes, int] = {}
        for i, r in zip(ids.tolist(), rows):
            if low.setdefault(r, i) > i:
                low[r] = i
        if len(low) < len(rows):
            ids = np.array([low[r] for r in rows], np.int64)
        order = np.lexsort((role, ids))
        keep = np.append(True, (ids[order][1:] != ids[order][:-1]) | (role[order][1:] != role[order][:-1]))
        order = order[keep]
        self.ids, role = ids[order], role[order]
        self.copies, self.met = (None, None) if copies is None else (copies[order], met[order])
        self.stored = np.flatnonzero((role == STORE) | (role == STORE_ONLY))
        self.query = np.flatnonzero(role != STORE_ONLY)
        self.probe = np.flatnonzero(role == PROBE)
        self.x = unpack([rows[i] for i in order], dim).astype(np.float64)
        mid = self.x.mean(0)
        self.low = (self.x - mid).astype(np.float32)
        self.sq = np.einsum("ij,ij->i", self.low, self.low)
        self.eps = float(4e-6 * max(self.sq.max(), 1e-12))

    def rough(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Squared distances in single precision, right to ``eps``; infinite for the same id."""
        d = self.low[rows] @ self.low[cols].T
        d *= -2
        d += self.sq[rows][:, None]
        d += self.sq[cols][None]
        same = np.searchsorted(self.ids[cols], self.ids[rows])
        hit = np.flatnonzero((same < len(cols)) & (self.ids[cols][np.minimum(same, len(cols) - 1)] == self.ids[rows]))
        d[hit, same[hit]] = np.inf
        return d

    def exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for s in range(0, len(i), 65536):
            diff = self.x[i[s : s + 65536]] - self.x[j[s : s + 65536]]
            out[s : s + 65536] = np.einsum("ij,ij->i", diff, diff)
        return out


def for_each_block(rows: DataFrame, dim: int, schema: pa.Schema, ddl: str, work: Callable[[Block], Iterator[pa.RecordBatch | dict]], min_stored: int = 1) -> DataFrame:
    """Run ``work`` on every block that holds a stored row and another row."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key = t.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        end = np.append(start[1:], len(key))
        ids, role = t.column("id").to_numpy(), t.column("role").to_numpy()
        vec = t.column("vec").combine_chunks()
        met = t.column("met").combine_chunks() if "met" in t.column_names else None
        copies = t.column("copies").to_numpy() if met is not None else None
        held: list[dict] = []
        size = 0
        for a, b in zip(start, end):
            if b - a < 2:
                continue
            at = order[a:b]
            if not ((role[at] == STORE) | (role[at] == STORE_ONLY)).any():
                continue
            more = ()
            if met is not None:
                m = np.frombuffer(b"".join(met.take(pa.array(at)).to_pylist()), np.int64)
                more = copies[at], m.reshape(len(at), -1, 2)
            block = Block(ids[at], role[at], vec.take(pa.array(at)).to_pylist(), dim, *more)
            if len(block.ids) < 2:
                continue
            for out in work(block):
                held.append(out)
                size += len(next(iter(out.values())))
                if size > 50_000:
                    yield _batch(held, schema)
                    held, size = [], 0
        if held:
            yield _batch(held, schema)

    return rows.mapInArrow(run, ddl)


def _batch(held: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate([h[f.name] for h in held]), f.type) for f in schema], schema=schema)


def block_neighbours(block: Block, k: int, max_d2: float, min_rows: int = 1024) -> Iterator[dict]:
    """The k nearest partners (by distance, then id) inside the block of stored and probing rows."""
    for rows, cols in ((block.stored, block.query), (block.probe, block.stored)):
        if not len(rows) or not len(cols):
            continue
        step = max(1, min(len(rows), (8 << 20) // len(cols) or 1))
        for s in range(0, len(rows), step):
            r = rows[s : s + step]
            d = block.rough(r, cols)
            if len(cols) > k:
                edge = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1], np.float32(max_d2)) + 2 * block.eps
            else:
                edge = np.full(len(r), min(max_d2, 3e38) + 2 * block.eps, np.float32)
            i, j = np.nonzero(d <= edge[:, None])
            if not len(i):
                continue
            exact = block.exact(r[i], cols[j])
            ok = exact <= max_d2
            i, j, exact = i[ok], j[ok], exact[ok]
            other = block.ids[cols[j]]
            order = np.lexsort((other, exact, i))
            i, exact, other = i[order], exact[order], other[order]
            begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
            rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
            ok = rank < k
            yield {"id": block.ids[r[i[ok]]], "other": other[ok], "d2": exact[ok]}
