"""Tables in the folder that the driver and all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..sources.place import bounded, file_system, folder, new_path  # noqa: F401


#: Seconds between two requests to collect garbage, and when the last one was.
GC_EVERY, _last_gc = 2.0, [0.0]


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The frame, written as Parquet and read again: lineage ends here, and a lost executor costs no recomputation. Shuffle
    files that nothing holds any more go when the JVM collects its garbage, so it is asked to now and then."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    if time.monotonic() - _last_gc[0] > GC_EVERY:
        spark._jvm.System.gc()
        _last_gc[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    system, at = file_system(spark, path)
    system.delete(at, True)


def drop(*frames: DataFrame) -> None:
    """Removes the files of frames from written() that nothing lazy reads any more."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            remove(df.sparkSession, path)
            df._written_path = None


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of the operator's own that the frame hasn't (Spark doesn't tell cases apart)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hash_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
