"""Folders that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch between the JVM and Python; both sides hold some of them for each task.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most BATCH_BYTES (or one row): ten thousand texts may be very long together."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", spark.conf.get(name))
    if not now or int(now[0]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return spark


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, one in the warehouse; only where all tasks run in this process,
    as in local tests, a temporary folder of this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="shared-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path for it)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again, so that what follows doesn't make them anew each time."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out._kept_path = path
    return out


def forget(rows: DataFrame) -> None:
    """Removes what kept() wrote, when nothing lazy reads it any more."""
    path = getattr(rows, "_kept_path", None)
    if path:
        system, at = file_system(rows.sparkSession, path)
        system.delete(at, True)
