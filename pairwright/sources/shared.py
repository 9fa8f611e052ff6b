"""The folder that driver and executors share, and the tables that are kept there for a while."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as
    every executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file as it is, byte for byte."""
    here, files = _file_system(spark, source)
    there, others = _file_system(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(files, here, others, there, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What lies directly in a folder; nothing where there is none."""
    where, files = _file_system(spark, folder)
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


class Kept:
    """Tables written to the shared folder, so that their lineage ends and a lost executor costs a new read.

    They last until ``forget``, or else until the process ends; results that read them end with them.
    """

    _ALL: set[Kept] = set()

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
        self.paths.append((spark, path))
        Kept._ALL.add(self)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        while self.paths:
            remove(*self.paths.pop())
        Kept._ALL.discard(self)

    @staticmethod
    def forget_all() -> None:
        for kept in list(Kept._ALL):
            try:
                kept.forget()
            except Exception:  # the session has ended: the cluster clears its own folder
                return


atexit.register(Kept.forget_all)
