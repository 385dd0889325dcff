"""Small files and folders on whatever file system the shared folder is on.

Only names and manifests pass through here (driver side, a few KB each); tables
are read and written by Spark.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Someone else has committed a file of that name."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> dict[str, int]:
    """{name: modification time in ms} of a folder's visible entries; empty if there is no such folder."""
    if not exists(spark, path):
        return {}
    entries = ((s.getPath().getName(), s.getModificationTime()) for s in _fs(spark, path).listStatus(_path(spark, path)))
    return {name: time for name, time in entries if not name.startswith((".", "_"))}


def delete(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """Make ``text`` appear under ``path`` whole or not at all; Conflict if the name is taken."""
    folder, name = path.rsplit("/", 1)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    out = _fs(spark, draft).create(_path(spark, draft))
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, draft), _path(spark, path), options)
    except Py4JJavaError as e:
        delete(spark, draft)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(path) from None
        raise


def state_of(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """What tells one state of some input tables from another: {path: files, bytes, latest time, hash of all names, sizes and times}.

    Listed and added up by Spark; one row a table reaches the driver.
    """
    def one(path: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        return files.agg(F.lit(path).alias("table"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"),
                         F.max("modificationTime").cast("string").alias("latest"),
                         F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("hash"))

    frames = [one(p) for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return {r.table: f"{r.n} files, {r.bytes} bytes, {r.latest}, {r.hash}" for r in out.collect()}
