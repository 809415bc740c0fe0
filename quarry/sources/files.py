"""Edge lists, LIBSVM, models, point blocks: text and binary files in and out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas


def read_edges_tsv(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Whitespace-separated ``v0 v1 [w]``; lines that begin with # and blank lines are skipped.

    Unweighted files get weight 0. A line with too few or unreadable fields raises an error.
    """
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"\s+")
    weight = F.element_at(part, 3).cast("double") if weighted else F.lit(0.0)
    return lines.select(F.element_at(part, 1).cast("long").alias("src"), F.element_at(part, 2).cast("long").alias("dst"), weight.alias("weight"))


def read_edges(spark: SparkSession, path: str, kind: str = "tsv", weighted: bool = False) -> DataFrame:
    if kind != "tsv":
        raise ValueError(f"unknown edge format {kind!r}")
    return read_edges_tsv(spark, path, weighted)


def write_edges(edges: DataFrame, path: str, kind: str = "mtx", single: bool = True) -> None:
    """``mtx``: a first line ``vertices edges``, then one line ``v0 v1`` an edge.

    ``single`` writes one file, by one task. Without it, for edges too many for that, the first part
    file holds the first line and the others the edges, task by task; put together in the order of
    their names they are the file.
    """
    if kind != "mtx":
        raise ValueError(f"unknown edge format {kind!r}")
    size = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")) + 1, F.lit(0)).alias("nv"), F.count(F.lit(1)).alias("ne"))
    head = size.select(F.concat_ws(" ", "nv", "ne").alias("value")).coalesce(1)
    out = head.union(edges.select(F.concat_ws(" ", "src", "dst").alias("value")))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """``label index:value ...`` as ``row_id, idx, val, label``.

    Labels -1/+1 become 0/1; indices stay as written, so the width is the largest index plus one.
    ``row_id`` increases in file order but has gaps.
    """
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("row_id"), part.alias("p"))
    pairs = F.slice("p", 2, F.size("p") - 1)
    return rows.select(
        "row_id",
        F.transform(pairs, lambda x: F.split_part(x, F.lit(":"), F.lit(1)).cast("int")).alias("idx"),
        F.transform(pairs, lambda x: F.split_part(x, F.lit(":"), F.lit(2)).cast("double")).alias("val"),
        ((F.element_at("p", 1).cast("double") + 1) / 2).alias("label"),
    )


def libsvm_width(rows: DataFrame) -> int:
    return int(rows.agg(F.coalesce(F.max(F.array_max("idx")) + 1, F.lit(0))).first()[0])


def write_model(spark: SparkSession, weights: list[float], path: str) -> None:
    """The number of features, then one weight a line."""
    spark.createDataFrame([(i, str(x)) for i, x in enumerate([len(weights), *weights])], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> list[float]:
    """A model is one vector, held by the driver by nature; its first line tells its length."""
    lines = [x for r in spark.read.text(path, wholetext=True).collect() for x in r["value"].split()]
    if not lines or int(lines[0]) != len(lines) - 1:
        raise ValueError("a model file starts with its number of weights")
    return [float(x) for x in lines[1:]]


def write_predictions(rows: DataFrame, path: str, id_col: str = "row_id", value_col: str = "prediction") -> None:
    """One value a line in row order."""
    rows.orderBy(id_col).select(F.col(value_col).cast("string")).write.mode("overwrite").text(path)


def read_csv_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A headerless CSV of numbers as ``row_id, features, label``; the last column is the label."""
    names = [f"c{i}" for i in range(columns)]
    raw = spark.read.csv(path, schema=", ".join(f"{n} double" for n in names))
    return raw.select(F.monotonically_increasing_id().alias("row_id"), F.array(*names[:-1]).alias("features"), F.col(names[-1]).alias("label"))


def matrix_frame(spark: SparkSession, matrix: np.ndarray) -> DataFrame:
    """A dense matrix in memory (rows, last column the label) as rows."""
    m = np.asarray(matrix, np.float64)
    table = pa.table({"row_id": pa.array(np.arange(len(m))), "features": pa.array(m[:, :-1].tolist(), pa.list_(pa.float64())), "label": pa.array(m[:, -1])})
    return spark.createDataFrame(table, schemas.DENSE_ROWS)


def read_point_blocks(spark: SparkSession, path: str, dim: int, chunk_points: int = 100_000) -> DataFrame:
    """Files of raw little-endian float32 points as ``file, at, coord``; a torn last point is an error.

    Only names and lengths are listed; tasks read ranges of ``chunk_points`` points, so a file of any
    size is read by many of them.
    """
    step = 4 * dim

    def parse(batches):
        for b in batches:
            for name, size, k in zip(b.column("path").to_pylist(), b.column("length").to_pylist(), b.column("chunk").to_pylist()):
                if size % step:
                    raise ValueError(f"{name} ends inside a point")
                source, at = fs.FileSystem.from_uri("file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name)
                with source.open_input_file(at) as f:
                    x = np.frombuffer(f.read_at(min(chunk_points * step, size - k * chunk_points * step), k * chunk_points * step), "<f4")
                n = len(x) // dim
                for s in range(0, n, 10_000):
                    e = min(n, s + 10_000)
                    place = np.arange(s, e) + k * chunk_points
                    yield pa.record_batch([pa.array([name] * (e - s)), pa.array(place), pa.ListArray.from_arrays(np.arange(0, (e - s) * dim + 1, dim, dtype=np.int32), pa.array(x[s * dim : e * dim]))], names=["file", "at", "coord"])

    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / (chunk_points * step)))).alias("chunk"))
    return chunks.repartition("path", "chunk").mapInArrow(parse, "file string, at long, coord array<float>")


def synthetic_points(spark: SparkSession, n: int, dim: int, seed: int = 1) -> DataFrame:
    """Uniform points; each coordinate is a hash of (point, axis, seed), so partitioning does not matter."""
    axis = F.sequence(F.lit(0), F.lit(dim - 1))
    return spark.range(n).select(F.col("id").alias("pid"), F.lit(1.0).cast("float").alias("weight"), F.transform(axis, lambda a: (F.pmod(F.xxhash64(F.col("id"), a, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)).cast("float")).alias("coord"))


def write_centres(centres: DataFrame, path: str) -> None:
    """Three lines a centre: id, weight, coordinates."""
    centres.orderBy("id").select(F.concat_ws("\n", F.col("id").cast("string"), F.col("weight").cast("string"), F.concat_ws(" ", F.col("coord").cast("array<string>"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


#: Fixed value: the polynomial x^16 + x^15 + x^2 + 1, bits reversed.
_CRC16 = 0xA001


def crc16(data: bytes, crc: int = 0) -> int:
    """CRC-16 of a buffer, for comparing dumps."""
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (_CRC16 if crc & 1 else 0)
    return crc


def crc16_column(df: DataFrame, column: str) -> DataFrame:
    """Adds ``crc16`` of a binary column; null stays null."""
    table = np.array([crc16(bytes([i])) for i in range(256)], np.uint16)

    @F.pandas_udf("int")
    def crc(s):
        def one(data):
            if data is None:
                return None
            c = 0
            for byte in data:
                c = c >> 8 ^ int(table[(c ^ byte) & 255])
            return c

        return s.map(one)

    return df.withColumn("crc16", crc(F.col(column)))


def read_flat(spark: SparkSession, path: str, schema, sep: str = "\t") -> DataFrame:
    """Flat files of separated fields under a given schema; a field that does not fit is an error."""
    return spark.read.schema(schema).option("sep", sep).option("mode", "FAILFAST").option("nullValue", "").csv(path)


def write_flat(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """The same, one file per task; nulls are empty fields."""
    rows.write.mode("overwrite").option("sep", sep).option("nullValue", "").option("emptyValue", "").csv(path)
