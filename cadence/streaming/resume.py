"""Apply a function to every keyed item, commit batch by batch, continue after a crash."""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.operators.keysets import assert_complete, assert_unique, remaining_items
from cadence.operators.ordering import (
    PART, SLOT, batch_bounds, columns, lay_out, part_offsets,
)
from cadence.runtime import temporary_stages
from cadence.sources.manifests import read_entries, read_manifest
from cadence.sources.states import committed_numbers

COMMIT_SECONDS = 120.0  # the usual pace of commits
BatchFunction = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def per_item(func: Callable, args: Sequence[str], result: str, keep: Sequence[str]) -> BatchFunction:
    """Lift ``func(*args)``, one call per item, to a function over Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [func(*row) for row in zip(*(frame[a] for a in args))]
            yield frame[list(keep)].assign(**{result: values})

    return run


def read_batches(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Union of the committed batches under ``root``, unfinished ones left out.

    A manifest, as streaming jobs keep, says what counts; without one each batch folder that
    holds a finished write does.
    """
    manifest = read_manifest(spark, root)
    if manifest is not None and manifest.entries:
        return read_entries(spark, root, manifest, schema)
    paths = [f"{root}/batch={n}" for n in committed_numbers(spark, root, "batch")]
    if not paths:
        if schema is None:
            raise FileNotFoundError(f"no committed batch under {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def _timed_bounds(total: int, batch_rows: int | None,
                  seconds: float) -> Iterator[tuple[int, int]]:
    """Position ranges which, by the pace of the one before, take about ``seconds`` each."""
    most = batch_rows or total
    start, size = 0, min(most, max(1, total // 100))
    while start < total:
        end, began = min(start + size, total), time.monotonic()
        yield start, end
        pace = (end - start) / max(time.monotonic() - began, 1e-3)
        start, size = end, max(1, min(most, int(pace * seconds)))


def _slices(remaining: DataFrame, keys: list[str], batch_rows: int | None,
            commit_seconds: float | None, parallelism: int | None) -> Iterator[DataFrame]:
    """Cut what is left into batches, in key order."""
    names = remaining.columns
    total = remaining.count()
    if total == 0:
        return
    if commit_seconds is not None:
        bounds = _timed_bounds(total, batch_rows, commit_seconds)
    else:
        bounds = batch_bounds(total, batch_rows)
    laid_out = lay_out(remaining, keys, "items")
    # one row per partition
    parts = sorted(part_offsets(laid_out).select("__before", PART).collect())
    before = [p["__before"] for p in parts]
    for start, end in bounds:
        lowest, highest = bisect_right(before, start) - 1, bisect_left(before, end) - 1
        first, last = parts[lowest][PART], parts[highest][PART]
        # a staged file holds one partition, so these bounds skip the other files
        inside = F.col(PART).between(first, last)
        inside &= (F.col(PART) > first) | (F.col(SLOT) >= start - before[lowest])
        inside &= (F.col(PART) < last) | (F.col(SLOT) < end - before[highest])
        cores = laid_out.sparkSession.sparkContext.defaultParallelism
        tasks = parallelism or max(highest - lowest + 1, cores)
        yield laid_out.where(inside).select(*columns(names)).repartition(tasks)


def resumable_map(items: DataFrame, key: str | Sequence[str], fn: BatchFunction,
                  out_schema: T.StructType | str, root: str | None,
                  batch_rows: int | None = None, commit_seconds: float | None = None,
                  strict: bool = False, parallelism: int | None = None) -> DataFrame:
    """Results of ``fn`` for all items, computing only those not stored under ``root``.

    ``fn`` maps Arrow batches of items to frames of ``out_schema``, which holds the key.
    Each batch of at most ``batch_rows`` items is one Parquet commit; a batch that fails
    stores nothing and the earlier ones stay.  ``commit_seconds`` sizes the batches, by
    the pace so far, to commit about that often; it is 120 unless one of the two is given.  ``strict`` checks that item keys are
    unique and that no stored key is unknown.  Without a root nothing is stored.
    ``items`` is read for counting, for the work and for the final check, so it should be
    a stored table.
    """
    spark = items.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    if isinstance(out_schema, str):
        out_schema = T.StructType.fromDDL(out_schema)
    absent = set(keys) - set(out_schema.names)
    if absent:
        raise ValueError(f"out_schema lacks the key {sorted(absent)}")
    if strict:
        assert_unique(items, *keys)
    if root is None:
        return items.mapInPandas(fn, out_schema)
    if batch_rows is None and commit_seconds is None:
        commit_seconds = COMMIT_SECONDS

    stored = committed_numbers(spark, root, "batch")
    done = read_batches(spark, root, out_schema)
    if strict and stored:
        unknown = remaining_items(done, items, keys).limit(5).collect()
        if unknown:
            raise ValueError(f"stored results of unknown items, for example: {unknown}")
    remaining = remaining_items(items, done, keys) if stored else items
    number = max(stored, default=-1)
    with temporary_stages(spark):
        for batch in _slices(remaining, keys, batch_rows, commit_seconds, parallelism):
            number += 1
            results = batch.mapInPandas(fn, out_schema)
            results.write.mode("overwrite").parquet(f"{root}/batch={number}")
    finished = read_batches(spark, root, out_schema)
    assert_complete(items, finished, keys)
    return finished
