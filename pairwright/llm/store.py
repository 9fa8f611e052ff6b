"""Where intermediate tables live: the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


_WRITTEN: list[str] = []
#: Lets Spark remove a query's shuffle files as soon as its table is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _forget(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(forget_all)
    _WRITTEN.append(path)
    return path


def forget_all() -> None:
    """Remove every table written here in this process; results that read them end too."""
    spark = SparkSession.getActiveSession()
    while _WRITTEN:
        path = _WRITTEN.pop()
        try:
            if spark is not None:
                _forget(spark, path)
        except Exception:  # the session has ended: the cluster clears its own folder
            return


def drop(frame_path: str) -> None:
    """Remove one written table before the session ends."""
    spark = SparkSession.getActiveSession()
    if spark is not None and frame_path in _WRITTEN:
        _WRITTEN.remove(frame_path)
        _forget(spark, frame_path)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here, and a lost executor costs no more than a new read."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path  # type: ignore[attr-defined]
    return out
