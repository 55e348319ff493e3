"""Cutting lineage, and tables that outlive a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
from functools import lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _folder_of_one_machine() -> str:
    return tempfile.mkdtemp(prefix="lexisift-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where it is unset, a temporary one on a single machine, and a RuntimeError on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
    return _folder_of_one_machine()


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file_system(spark, path)
    return fs.exists(at)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames the folder `path`; if another job has made `to` in the meantime, that one stays."""
    fs, at = _file_system(spark, path)
    if fs.exists(_file_system(spark, to)[1]) or not fs.rename(at, _file_system(spark, to)[1]):
        fs.delete(at, True)


def file_states(spark: SparkSession, path: str) -> list[str]:
    """Name, length and time of change of the files of `path`: they tell whether it has changed."""
    fs, at = _file_system(spark, path)
    return sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(at))


def scratch(spark: SparkSession) -> str:
    """A new name in the shared folder for what is needed until the driver ends."""
    path = f"{shared_folder(spark)}/table-{uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """`df`, computed once and written as a Parquet table in the shared folder, until the driver ends: for tables that are read several times by columns."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared checkpoint folder. The result survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
