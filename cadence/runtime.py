"""Where intermediate tables live, and the few file-system calls the sources need."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes = threading.local()  # a streaming job stores its batches on a thread of its own


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    It is the session's ``spark.checkpoint.dir``.  Only a local master without that
    setting gets a temporary folder; a cluster without it is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    already_set = context.getCheckpointDir()
    if already_set:
        return already_set.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="cadence-"))
    return context.getCheckpointDir().rstrip("/")


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path under this application's part of the staging folder."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/cadence-{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the staging folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    open_scopes = getattr(_scopes, "paths", None)
    if open_scopes:
        open_scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Deal rows evenly over at least ``per_core`` tasks a core, before slow work on each row.

    A compact file is one split however many rows it holds, and one task would work on all.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(df.rdd.getNumPartitions(), per_core * cores))


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """Drop what is staged inside the block at its end, for jobs that store their result."""
    if not hasattr(_scopes, "paths"):
        _scopes.paths = []
    _scopes.paths.append([])
    try:
        yield
    finally:
        for path in _scopes.paths.pop():
            remove(spark, path)


def clear_staging(spark: SparkSession) -> None:
    """Drop what this application staged; call it once its results are stored."""
    app = spark.sparkContext.applicationId
    remove(spark, f"{staging_root(spark)}/cadence-{app}")


def _locate(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of the file system that Spark takes it to."""
    fs, where = _locate(spark, path)
    return fs.makeQualified(where).toString()


def is_committed(spark: SparkSession, path: str) -> bool:
    """True when a write to ``path`` finished: Spark adds ``_SUCCESS`` last."""
    fs, where = _locate(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under ``path``; none when it does not exist."""
    fs, where = _locate(spark, path)
    if not fs.exists(where):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what is directly under ``path``; none when it does not exist."""
    fs, where = _locate(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text, read by the driver."""
    fs, where = _locate(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver; it appears whole or not at all."""
    fs, where = _locate(spark, path)
    unfinished = spark._jvm.org.apache.hadoop.fs.Path(f"{where.getParent()}/.{uuid.uuid4().hex}.tmp")
    stream = fs.create(unfinished, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    if not fs.rename(unfinished, where):
        fs.delete(unfinished, False)
        raise OSError(f"{path} could not be written")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _locate(spark, path)
    fs.delete(where, True)


def quoted(name: str) -> str:
    """Column name safe to pass to ``F.col`` even when it holds dots."""
    return "`" + name.replace("`", "``") + "`"
