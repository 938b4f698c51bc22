"""Small files and folder listings through Hadoop's file systems, so that any path Spark reads works."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _open(spark, path)
    return files.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it does not exist."""
    target, files = _open(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was last changed, by the clock of this machine."""
    target, files = _open(spark, path)
    return (spark._jvm.System.currentTimeMillis() - files.getFileStatus(target).getModificationTime()) / 1000


def read_small(spark: SparkSession, path: str) -> str:
    """Text of a small control file, read on the driver."""
    target, files = _open(spark, path)
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small(spark: SparkSession, path: str, text: str) -> None:
    target, files = _open(spark, path)
    stream = files.create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a file or folder; False, and nothing done, if the new name is taken.

    One step on HDFS and on local disks. On an object store without a rename of its own it is as good as the connector's.
    """
    jvm = spark._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    plain = spark.sparkContext._gateway.new_array(kind, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, plain)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    target, files = _open(spark, path)
    files.delete(target, True)
