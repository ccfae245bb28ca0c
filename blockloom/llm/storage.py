"""The folder that driver and executors share, and lineage cuts written to it."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local session without it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="blockloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path (URI) in the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint, which outlives any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage and the planner's size estimates start anew, which a
    checkpoint's don't, so that loops can join such tables round after round."""
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or plain path, for use on executors as well."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


def delete_folder(spark: SparkSession, uri: str) -> None:
    """Remove a folder by Hadoop's own file system for its scheme; no error if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def process_cache() -> dict:
    """A dict that lives as long as the Python process; functions pickled by value have no lasting globals."""
    return vars(sys).setdefault("_blockloom_process_cache", {})


def give_back() -> None:
    """Freed memory goes back to the system; Arrow's pool and glibc would keep most of it, of large arrays too."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def frugal(run: Callable[[Iterator], Iterator], keep_cache: bool = False) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches in Python workers, which stay for other tasks and wait beside the JVM's own: after a task what it freed
    is given back. Without ``keep_cache`` the process cache, which other operators filled, goes before the task."""

    def task(batches: Iterator) -> Iterator:
        if not keep_cache and (known := process_cache()):
            known.clear()
            gc.collect()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
