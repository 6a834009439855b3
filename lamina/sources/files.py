"""Small driver-side file calls, on whatever file system the path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _locate(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def uri(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark names the files below it."""
    fs, folder = _locate(spark, path)
    return fs.makeQualified(folder).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty when it does not exist."""
    fs, folder = _locate(spark, path)
    if not fs.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(folder))


def read_text(spark: SparkSession, path: str) -> str:
    fs, file = _locate(spark, path)
    stream = fs.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Create ``path`` whole by one rename; an error if it is already there."""
    fs, file = _locate(spark, path)
    _, hidden = _locate(spark, f"{file.getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(hidden)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    if fs.exists(file) or not fs.rename(hidden, file):
        fs.delete(hidden, False)
        raise FileExistsError(f"{path} was written by another run")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    fs, target = _locate(spark, path)
    return fs.getContentSummary(target).getLength()


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _locate(spark, path)
    fs.delete(target, True)
