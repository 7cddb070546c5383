"""Tables computed once and read back afterwards."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadence.runtime import children, is_committed

log = logging.getLogger(__name__)

_MARKS = "mapreduce.fileoutputcommitter.marksuccessfuljobs"


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at ``path``; false if nothing or an unfinished write is.

    Spark marks a finished write with ``_SUCCESS`` and keeps ``_temporary`` until then.  Files
    with neither, as other writers leave them, may be a whole table or a part: that raises.
    """
    if is_committed(spark, path):
        return True
    names = children(spark, path)
    if "_temporary" in names or all(n.startswith(("_", ".")) for n in names):
        return False
    raise ValueError(f"{path} holds files without {'_SUCCESS'!r}: not known to be whole")


def write_snapshot(df: DataFrame, path: str) -> None:
    marks = df.sparkSession._jsc.hadoopConfiguration().get(_MARKS)
    if marks is not None and marks.lower() == "false":
        raise RuntimeError(f"snapshots need success markers; {_MARKS} is false")
    df.write.mode("overwrite").parquet(path)


def append_results(df: DataFrame, path: str) -> None:
    """Add a chunk of results to those at ``path``."""
    df.write.mode("append").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_first_available(spark: SparkSession, *paths: str) -> DataFrame:
    """The first path with a finished table; see :func:`is_ready` for the others."""
    for path in paths:
        if is_ready(spark, path):
            return read_snapshot(spark, path)
        log.debug("Skipping %s: no finished table", path)
    raise FileNotFoundError("Failed to load a table from any of", list(paths))


def compute_or_load(spark: SparkSession, path: str, build: Callable[..., DataFrame],
                    *args, silent: bool = False, **kwargs) -> DataFrame:
    """Read the table at ``path``, or build it, store it there and read it back.

    It is built if the path is missing, empty or an unfinished write; other content is never
    overwritten (see :func:`is_ready`).  The arguments are not part of the cache key, the path
    alone is.
    """
    start = time.monotonic()
    if is_ready(spark, path):
        outcome = "Found"
    else:
        write_snapshot(build(*args, **kwargs), path)
        outcome = "Computed and stored"
    if not silent:
        log.info("%s %s in %.2fs", outcome, path, time.monotonic() - start)
    return read_snapshot(spark, path)


def stash(spark: SparkSession, path: str, active: bool = True, silent: bool = False) -> Callable:
    """Caller that goes through ``compute_or_load``, or straight through if inactive."""

    def call(build: Callable[..., DataFrame], *args, **kwargs) -> DataFrame:
        if not active:
            return build(*args, **kwargs)
        return compute_or_load(spark, path, build, *args, silent=silent, **kwargs)

    return call
