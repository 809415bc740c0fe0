"""Session construction and the shared scratch space used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
#: Folders of operator calls, by application.
_ROOTS: dict[str, list[str]] = {}


def build_session(app: str = "quarry", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for local runs; on a cluster the submitter's session is used as it is."""
    cpus = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is an in-process one (tests, notebooks) is a
    temporary folder made; on a cluster an unset folder is an error, since a machine-local path
    would be lost with its executor.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[key] = tempfile.mkdtemp(prefix="quarry-")
        sc.setCheckpointDir(_LOCAL_SCRATCH[key])
    return _LOCAL_SCRATCH[key]


class Scratch:
    """Written intermediate tables of one operator call.

    ``write`` stores a DataFrame as Parquet in the shared folder and reads it back: the lineage is
    cut, a lost executor costs nothing, and the planner sees real sizes. ``drop`` removes a table
    that no later step reads (superseded rounds of a loop). Tables that the returned, lazy result
    still reads stay until ``clear_scratch`` or the end of the application.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        path, fs = _hadoop(spark, self.root)
        fs.deleteOnExit(path)
        _ROOTS.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def clear(self) -> None:
        """Removes everything this call has written."""
        _delete(self.spark, self.root)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_quarry_path", None)
        if path:
            _delete(self.spark, path)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def clear_scratch(spark: SparkSession) -> int:
    """Removes the tables of all operator calls of this application so far and returns their number.

    For long sessions, once the results have been written; results not yet read are lost.
    """
    roots = _ROOTS.pop(spark.sparkContext.applicationId, [])
    for r in roots:
        _delete(spark, r)
    return len(roots)


def row_bytes_estimate(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan in bytes (exact for written tables)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 8 << 20) -> DataFrame:
    """A broadcast hint behind a size check; larger inputs keep the planner's shuffle join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if row_bytes_estimate(df) <= limit_bytes else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
