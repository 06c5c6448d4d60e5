"""Cutting lineage through tables in the cluster's shared folder.

A written table survives the loss of executors, unlike a local checkpoint, and unlike
``checkpoint()`` it is compressed and column-pruned when it is read again.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LIVE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing and the master is local (tests), a temporary folder is set;
    on a cluster without the setting the call fails, as executors could not share such a folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", where)
        remove_later(spark, where)
    return where.rstrip("/")


def remove_later(spark: SparkSession, path: str) -> None:
    """Delete a path when the process ends."""
    if not _LIVE:
        atexit.register(lambda: [_quiet(p, s) for s, p in _LIVE])
    _LIVE.append((spark, path))


def _quiet(path: str, spark: SparkSession) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone at exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    fs, p = _file_system(spark, path)
    return bool(fs.exists(p))


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, written through Hadoop's file system."""
    fs, p = _file_system(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


class Stored:
    """A written table: ``df`` reads it, ``drop()`` deletes it once nothing needs it."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def store(df: DataFrame, label: str = "t") -> Stored:
    """Write ``df`` as parquet in the shared folder and read it back; empty tables keep their schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmark/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    remove_later(spark, path)
    return Stored(spark, path, df.schema)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """``store(df).df``: for tables that the result still needs."""
    return store(df, label).df
