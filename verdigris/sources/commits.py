"""Small commit records beside data: what a record names is there, what none names isn't.

Records are text files in any of Spark's file systems, written under another name
and then renamed, so a reader sees a whole record or none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a record unless it is there; whether it was written by this call."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return False
    fs.mkdirs(at.getParent())
    _, draft = _fs(spark, f"{at.getParent()}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        return False
    return True


def get(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    size = fs.getFileStatus(at).getLen()
    stream = fs.open(at)
    try:
        reader = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils
        held = spark.sparkContext._jvm.java.io.ByteArrayOutputStream(max(1, size))
        reader.copyBytes(stream, held, 4096, False)
        return held.toByteArray().decode() if size else ""
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the records of a folder, in order; drafts aren't records."""
    fs, at = _fs(spark, folder)
    if not fs.exists(at):
        return []
    return sorted(name for s in fs.listStatus(at) if not (name := s.getPath().getName()).startswith((".", "_")))


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)
