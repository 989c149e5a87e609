"""The folder that driver and executors share, and tables written there to fix a result before it is used twice."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="rowmesh-")


@lru_cache(maxsize=64)
def _own_folder(folder: str, application: str) -> str:
    """The application's own folder, which goes when its driver ends."""
    spark, path = SparkSession.active(), f"{folder}/rowmesh/{application}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by, so that every reader means the same file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder of its own; on a
    cluster it is an error, as executors would each write to a disk of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{_local_folder(spark.sparkContext.applicationId)}"
    return qualified(spark, found).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before; it goes when the session's driver ends, or with clear()."""
    return f"{_own_folder(shared_folder(spark), spark.sparkContext.applicationId)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove all that the application has written by new_folder() so far; queries not yet run that rest on it fail."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(shared_folder(spark), spark.sparkContext.applicationId))
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for one in files.listStatus(hadoop):
        files.delete(one.getPath(), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its rows no longer depend on the tasks that made them."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table of written() that nothing rests on any more."""
    spark = df.sparkSession
    own = _own_folder(shared_folder(spark), spark.sparkContext.applicationId)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.makeQualified(hadoop.getParent()).equals(files.makeQualified(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own))):
            files.delete(hadoop, True)
