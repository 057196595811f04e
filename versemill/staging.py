"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage and survives the loss of executors: it is plain Parquet
in the folder named by ``spark.checkpoint.dir``. Only a local session without that
setting falls back to a temporary folder.

Results are lazy and read staged tables when they are used, so their user tells when they
are done: tables made within a :func:`scope` are removed at its end, all others at the end
of the Python process. Nothing is removed that this module did not name.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_local_folders: dict[str, str] = {}


class Scope:
    """The paths named since it was opened; threads that run its context share it."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self._lock = threading.Lock()

    def add(self, path: str) -> None:
        with self._lock:
            self.paths.append(path)

    def keep(self, path: str) -> str:
        """Leave a path, and what lies below it, to the scope around or the process."""
        with self._lock:
            if path in self.paths:
                self.paths.remove(path)
        return path

    def remove(self) -> None:
        """Delete what is left, on the file system it belongs to."""
        with self._lock:
            paths, self.paths = self.paths, []
        context = SparkContext._active_spark_context
        jvm = SparkContext._jvm
        if not paths or jvm is None:
            return
        hadoop = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(hadoop).delete(target, True)


_process = Scope()
_open: ContextVar[Scope] = ContextVar("versemill_scope", default=_process)
atexit.register(_process.remove)


@contextmanager
def scope() -> Iterator[Scope]:
    """Remove the tables staged inside when it ends, also by an error.

    Use results inside: a frame that reads a removed table fails. Scopes may be nested, and
    each thread has its own unless it runs in a copied context.
    """
    made = Scope()
    token = _open.set(made)
    try:
        yield made
    finally:
        _open.reset(token)
        made.remove()


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Actions inside remove the shuffle files they wrote when they end.

    Otherwise the files stay until the driver happens to collect garbage, the more of them
    the larger its memory. A frame that is used again writes them anew.
    """
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def work_dir(spark: SparkSession) -> str:
    """Folder for staged tables, shared by all executors."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    # executors of local-cluster are processes of their own
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="versemill-")
    return _local_folders[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the work folder, which goes with the open scope."""
    path = f"{work_dir(spark)}/versemill/{label}-{uuid.uuid4().hex}"
    _open.get().add(path)
    return path


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    path = new_path(df.sparkSession, label)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index", start: int = 0) -> DataFrame:
    """Number the rows consecutively in the given order, without a one-task window.

    The sorted frame is written once; a row's number is its position within its file plus
    the number of rows in the files before it. Only the table of file sizes (one row per
    written file) is ordered in a single task.
    """
    staged = stage(df.orderBy(*order), "sorted").select(
        "*",
        F.col("_metadata.file_name").alias("_index_file"),
        F.col("_metadata.row_index").alias("_index_row"),
    )
    part = F.regexp_extract("_index_file", r"part-(\d+)-.*-c(\d+)", 1).cast("long")
    piece = F.regexp_extract("_index_file", r"part-(\d+)-.*-c(\d+)", 2).cast("long")
    earlier = Window.orderBy(part, piece).rowsBetween(Window.unboundedPreceding, -1)
    files = (
        staged.groupBy("_index_file")
        .agg(F.count("*").alias("_index_rows"))
        .select("_index_file", F.coalesce(F.sum("_index_rows").over(earlier), F.lit(0)).alias("_index_before"))
    )
    return (
        staged.join(F.broadcast(files), "_index_file")
        .withColumn(name, F.col("_index_before") + F.col("_index_row") + F.lit(start))
        .drop("_index_file", "_index_row", "_index_before")
    )
