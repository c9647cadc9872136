"""Folders every executor can reach, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only where the setting is absent and the
    session is local, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders settled within ``scratch``, by the thread that is in it.
_SCRATCH: dict[int, list[str]] = {}


@contextmanager
def scratch(spark: SparkSession):
    """What is settled inside is deleted at the end, also after a failure. For steps that are repeated
    without end, such as the micro-batches of a stream; their results must have been written by then."""
    thread = threading.get_ident()
    outer = _SCRATCH.get(thread)
    folders = _SCRATCH[thread] = []
    try:
        yield
    finally:
        del _SCRATCH[thread]
        if outer is not None:
            _SCRATCH[thread] = outer
        for folder in folders:
            discard(spark, folder)


def settle(
    df: DataFrame, name: str, compression: str = "snappy", folder: str | None = None
) -> DataFrame:
    """The same rows read back from a written table: computed once, safe against lost executors."""
    spark = df.sparkSession
    if folder is None:
        folder = shared_folder(spark, name)
        if (passing := _SCRATCH.get(threading.get_ident())) is not None:
            passing.append(folder)
    df.write.parquet(folder, compression=compression)
    return spark.read.schema(df.schema).parquet(folder)


def file_system(spark: SparkSession, folder: str):
    """The folder's path and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this library wrote and that nothing reads any more."""
    path, files = file_system(spark, folder)
    files.delete(path, True)
