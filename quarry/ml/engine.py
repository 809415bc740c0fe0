"""Epochs of user functions over row blocks.

Rows are packed once into files of plain matrices in the shared folder, one per task. An epoch sends
tasks the names of their files, never the rows: a worker maps a file into memory, where it stays in
the system's cache from epoch to epoch. (Where the shared folder is no file system that Python can
open, blocks are kept in Spark's storage instead.) A registered function sees a piece of a file and
the model:

* a *row* function ``f(X, y, w) -> (loss sum, gradient or None)``; gradients are summed over all
  tasks (mini-batch form, the reproducible counterpart of a shared model);
* an *update* function ``f(X, y, w) -> w`` folds a partition's rows in order; the models of the
  partitions are averaged by rows (replicated models), or merged by a function of the user's;
* a *column* function ``f(j, x_j, d, y, w_j) -> gradient`` over one column and the current scores
  (coordinate access), and a *column-to-row* function ``f(j, x_j, X, y, w) -> gradient``, which also
  sees the rows that the column touches.

Partial results are summed by Spark per position; the driver holds one model and nothing per row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import Scratch, broadcast_if_small

BLOCK_BYTES = 4 << 20
#: Bytes of a file that a function sees at a time, few enough for the caches of a core.
PIECE_BYTES = 1 << 20


def pack_blocks(rows: DataFrame, width: int) -> DataFrame:
    """``n, x, y`` blocks from ``features ARRAY<DOUBLE>, label``; rows with a null or a wrong width
    are an error. NaN labels stay NaN. ``row_id`` order inside a partition is kept."""
    step = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, step):
                c = b.slice(s, step)
                x = np.asarray(c.column(0).flatten(), np.float64)
                if len(x) != c.num_rows * width or c.column(1).null_count:
                    raise ValueError(f"every row needs {width} features and a label")
                y = np.asarray(c.column(1), np.float64)
                yield pa.record_batch([pa.array([c.num_rows], pa.int64()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["n", "x", "y"])

    return rows.select("features", F.col("label").cast("double")).mapInArrow(run, "n long, x binary, y binary")


def write_blocks(rows: DataFrame, width: int, root: str) -> DataFrame:
    """``n, path``: a file per task with the rows' features, then their labels, as doubles.

    A task that runs twice leaves a file that nothing names. Rows as ``pack_blocks`` wants them.
    """
    packed = pack_blocks(rows, width)

    def run(batches):
        target, base = fs.FileSystem.from_uri(root)
        target.create_dir(base)
        name = uuid.uuid4().hex
        n, labels = 0, []
        with target.open_output_stream(f"{base}/{name}") as out:
            for b in batches:
                for k, x, y in zip(b.column("n").to_pylist(), b.column("x"), b.column("y")):
                    out.write(x.as_buffer())
                    labels.append(y.as_py())
                    n += k
            out.write(b"".join(labels))
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([f"{root}/{name}"])], names=["n", "path"])
        else:
            target.delete_file(f"{base}/{name}")

    return packed.mapInArrow(run, "n long, path string")


def opened(batches, width: int) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Per file (or stored block) its pieces as matrix and labels."""
    step = max(1, PIECE_BYTES // (8 * max(1, width)))

    def pieces(x: np.ndarray, y: np.ndarray):
        for s in range(0, len(y), step):
            yield x[s : s + step], y[s : s + step]

    for b in batches:
        if "path" not in b.schema.names:
            yield (m for n, x, y in zip(b.column("n").to_pylist(), b.column("x"), b.column("y")) for m in pieces(np.frombuffer(x.as_buffer(), np.float64).reshape(n, width), np.frombuffer(y.as_buffer(), np.float64)))
            continue
        for n, path in zip(b.column("n").to_pylist(), b.column("path").to_pylist()):
            source, at = fs.FileSystem.from_uri(path)
            if isinstance(source, fs.LocalFileSystem):
                flat = np.memmap(at, np.float64, "r")
            else:
                with source.open_input_file(at) as f:
                    flat = np.frombuffer(f.read_buffer(), np.float64)
            yield pieces(flat[: n * width].reshape(n, width), flat[n * width :])


def unpack_blocks(batches, width: int):
    for file in opened(batches, width):
        yield from file


def _openable(root: str) -> bool:
    try:
        fs.FileSystem.from_uri(root)
    except Exception:  # an unknown scheme, or one whose library is not there
        return False
    return True


class Engine:
    """Rows, a model width, and registered functions run by ``exec``."""

    def __init__(self, rows: DataFrame, width: int, partitions: int | None = None, replicas: int = 1):
        """``replicas`` > 1 shows every row to that many workers, so sums come out that many times."""
        src = rows.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(replicas)))) if replicas > 1 else rows
        if partitions:
            src = src.repartitionByRange(partitions, "row_id").sortWithinPartitions("row_id")
        self.spark, self.width = rows.sparkSession, width
        self.scratch = Scratch(self.spark, "blocks")
        if _openable(self.scratch.root):
            names = self.scratch.write(write_blocks(src, width, f"{self.scratch.root}/files"))
            # the names alone are kept, a task's worth of files in each partition
            tasks = max(1, min(names.count(), 4 * self.spark.sparkContext.defaultParallelism))
            self.blocks = names.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
        else:
            self.blocks = pack_blocks(src, width).persist(StorageLevel.MEMORY_AND_DISK)
        self._functions: list[tuple[str, Callable]] = []
        self._merge: Callable | None = None

    def close(self) -> None:
        self.blocks.unpersist()
        self.scratch.clear()

    def register_c2r(self, f: Callable) -> int:
        self._functions.append(("c2r", f))
        return len(self._functions) - 1

    def register_model_avg(self, merge: Callable) -> None:
        """``merge(a, rows_a, b, rows_b) -> model`` takes the place of the average by rows; it must be
        associative, as partitions are merged in a tree."""
        self._merge = merge

    def register_row(self, f: Callable) -> int:
        self._functions.append(("row", f))
        return len(self._functions) - 1

    def register_update(self, f: Callable) -> int:
        self._functions.append(("update", f))
        return len(self._functions) - 1

    def register_column(self, f: Callable) -> int:
        self._functions.append(("col", f))
        return len(self._functions) - 1

    def exec(self, handle: int, model: np.ndarray, rate: float = 1.0, shared=None) -> tuple[float, np.ndarray]:
        """Runs one function over all rows: (summed value, new model). ``shared`` is passed on as a
        keyword if given."""
        kind, f = self._functions[handle]
        w = np.asarray(model, np.float64)
        extra = {} if shared is None else {"shared": shared}
        if kind == "row":
            total, g, _ = self._sums(lambda x, y: f(x, y, w, **extra))
            return total, w - rate * g
        if kind == "update":
            total, s, n = self._folds(lambda x, y, m: f(x, y, m, **extra), w)
            return total, s / n if n else w
        columns = Engine._touched if kind == "c2r" else Engine._columns
        total, g, _ = self._sums(lambda x, y: columns(f, x, y, w, extra))
        return total, w - rate * g

    @staticmethod
    def _columns(f: Callable, x: np.ndarray, y: np.ndarray, w: np.ndarray, extra: dict) -> tuple[float, np.ndarray]:
        d = x @ w
        return 0.0, np.array([f(j, x[:, j], d, y, w[j], **extra) for j in range(x.shape[1])])

    @staticmethod
    def _touched(f: Callable, x: np.ndarray, y: np.ndarray, w: np.ndarray, extra: dict) -> tuple[float, np.ndarray]:
        g = np.zeros(len(w))
        for j in range(x.shape[1]):
            at = np.flatnonzero(x[:, j])
            if len(at):
                g[j] = f(j, x[at, j], x[at], y[at], w, **extra)
        return 0.0, g

    def _sums(self, f: Callable) -> tuple[float, np.ndarray, int]:
        width = self.width

        def run(batches):
            g, total, n = np.zeros(width), 0.0, 0
            for x, y in unpack_blocks(batches, width):
                t, part = f(x, y)
                total, n = total + float(t), n + len(y)
                if part is not None:
                    g += part
            yield from _vector(g, total, n)

        return self._collect(run)

    def _folds(self, f: Callable, w: np.ndarray) -> tuple[float, np.ndarray, int]:
        width, merge = self.width, self._merge

        def models(batches):
            for file in opened(batches, width):
                m, n = w.copy(), 0
                for x, y in file:
                    m = f(x, y, m)
                    n += len(y)
                if n:
                    yield m, n

        def run(batches):
            total, n = np.zeros(width), 0
            for m, k in models(batches):
                total, n = total + m * k, n + k
            yield from _vector(total, 0.0, n)

        if merge is None:
            return self._collect(run)

        def merged(pairs):
            have = None
            for m, k in pairs:
                have = (m, k) if have is None else (merge(*have, m, k), have[1] + k)
            if have:
                yield pa.record_batch([pa.array([have[1]], pa.int64()), pa.array([have[0].tolist()], pa.list_(pa.float64()))], names=["n", "m"])

        level = self.scratch.write(self.blocks.mapInArrow(lambda b: merged(models(b)), "n long, m array<double>"))
        left = level.count()
        while left > 1:
            left = -(-left // 16)
            again = level.repartition(left).mapInArrow(lambda b: merged((np.array(m), n) for x in b for n, m in zip(x.column("n").to_pylist(), x.column("m").to_pylist())), "n long, m array<double>")
            level = self.scratch.write(again)
            left = level.count() if left > 1 else 1
        r = level.first()
        return (0.0, np.array(r["m"]) * r["n"], r["n"]) if r else (0.0, np.zeros(width), 0)

    def _collect(self, run) -> tuple[float, np.ndarray, int]:
        """Sums by position over the tasks; positions width and width + 1 hold the value and the count."""
        got = self.blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(self.width + 2)
        out[got.column("i").to_numpy()] = got.column("v").to_numpy()
        return out[self.width], out[: self.width], int(out[self.width + 1])


def _vector(v: np.ndarray, total: float, n: int):
    full = np.concatenate([v, [total, n]])
    at = np.flatnonzero(full)
    yield pa.record_batch([pa.array(at), pa.array(full[at])], names=["i", "v"])


def sparse_gradient(rows: DataFrame, model: DataFrame, residual: Callable) -> DataFrame:
    """Gradient ``col, g`` of sparse rows ``row_id, idx, val, label`` against a model ``col, w``.

    The dot product is a join on the feature, so a model of any width works: nothing is broadcast
    unless the planner finds it small. ``residual(dot, label)`` is a column expression.
    """
    cells = rows.select("row_id", "label", F.explode(F.arrays_zip("idx", "val")).alias("z")).select("row_id", "label", F.col("z.idx").alias("col"), F.col("z.val").alias("x"))
    dots = cells.join(model, "col", "left").groupBy("row_id", "label").agg(F.sum(F.col("x") * F.coalesce("w", F.lit(0.0))).alias("d"))
    r = dots.select("row_id", residual(F.col("d"), F.col("label")).alias("r"))
    return cells.join(r, "row_id").groupBy("col").agg(F.sum(F.col("x") * F.col("r")).alias("g"))


def ordered_fold(rows: DataFrame, width: int, f: Callable, model: np.ndarray) -> np.ndarray:
    """The exact sequential fold of ``f(x, y, w) -> w`` in row order, one partition after another.

    Blocks of rows come to the driver one at a time (bounded by ``BLOCK_BYTES``); for checks, as it
    uses no parallelism.
    """
    w = np.asarray(model, np.float64).copy()
    ordered = rows.orderBy("row_id")
    for r in pack_blocks(ordered, width).toLocalIterator():
        x, y = np.frombuffer(r["x"]).reshape(r["n"], width), np.frombuffer(r["y"])
        for xi, yi in zip(x, y):
            w = f(xi, yi, w)
    return w


def row_numbers(df: DataFrame, order: str) -> DataFrame:
    """Dense row ids without one global window: counts per range partition give the offsets."""
    part = df.repartitionByRange(F.col(order)).withColumn("__p", F.spark_partition_id())
    n = part.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    off = n.withColumn("o", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__p", "o")
    w = Window.partitionBy("__p").orderBy(order)
    return part.withColumn("__k", F.row_number().over(w)).join(broadcast_if_small(off), "__p").withColumn("row_id", F.col("o") + F.col("__k") - 1).drop("__p", "__k", "o")
