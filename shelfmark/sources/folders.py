"""Folders of whatever storage Spark reads: listing one, and putting one in place in one step."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from shelfmark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as files in the shared folder; for tables too large for :func:`~shelfmark.functions.sizing.settled`."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder``, in order; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(path))


def put_in_place(spark: SparkSession, prepared: str, target: str) -> None:
    """Rename ``prepared`` to ``target``; an existing ``target`` stays, and is an error."""
    hadoop, configuration = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source, path = hadoop.Path(prepared), hadoop.Path(target)
    path.getFileSystem(configuration).mkdirs(path.getParent())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    qualified = path.getFileSystem(configuration).makeQualified(path)
    context = hadoop.FileContext.getFileContext(qualified.toUri(), configuration)
    try:
        context.rename(source, path, none)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise FileExistsError(target) from error
        raise
