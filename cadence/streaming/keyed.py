"""Per-key state over a stream: throttling and weighted means."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadence.operators.averages import last_value, weighted_mean
from cadence.operators.keysets import latest_by_key
from cadence.operators.ordering import KEY, columns, key_struct
from cadence.operators.throttling import (
    MAX_KEY_ROWS, POSITION, TIME, Clock, advanced_clocks, fire, fired_rows, make_rule, micros_of,
)
from cadence.runtime import remove, stage, temporary_stages
from cadence.sources.manifests import Entry, Manifest, claim, commit, read_manifest, write_manifest
from cadence.streaming.incremental import MERGE_BATCHES, store_batch

WHOLE_CLOCKS = 10  # micro-batches whose changed clocks are put together with all others
STATE_BUCKETS = 4096
"""Groups of keys whose clocks a streaming throttle keeps together, each in one call of Python."""
_CLOCKS = (
    "buckets int, ids array<string>, positions array<bigint>, last_indexes array<bigint>, last_micros array<bigint>"
)
_ID, _BUCKET = "__id", "__bucket"
_VERSION = "__version"


def _plain(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether keys are equal to Spark just when they are written alike."""
    kinds = (T.IntegralType, T.BooleanType, T.DateType, T.DecimalType)
    types = [df.select(c).schema[0].dataType for c in columns(keys)]
    return all(isinstance(t, kinds) or t == T.StringType() for t in types)


def _in_order(rows: pd.DataFrame, codes: np.ndarray, times: np.ndarray, ties: Sequence[str]) -> np.ndarray:
    """Offsets of rows by key, time and ties; the rest as they came."""
    order = np.lexsort([times, codes])
    if ties and ((np.diff(codes[order]) == 0) & (np.diff(times[order]) == 0)).any():
        tied = rows[list(ties)].reset_index(drop=True).sort_values(list(ties), kind="stable").index.to_numpy()
        order = tied[np.lexsort([times[tied], codes[tied]])]
    return order


def stream_throttle(stream: DataFrame, keys: str | Sequence[str], time: str,
                    ties: Sequence[str] = (), step_spec: str = "::",
                    seconds: float | None = None, iters: int | None = None,
                    reset_index: bool = True, buckets: int | None = STATE_BUCKETS) -> DataFrame:
    """Streaming form of ``throttle``; append mode.

    A key's rows are put in order within a micro-batch and taken as they come across
    micro-batches.  The state is one clock per key and stays for good.  One task takes
    a key's share of a micro-batch, so bound those at the source; for large backlogs or
    keys with a large share use ``throttle_job``.

    Keys are dealt by their hash over ``buckets``, whose rows Python takes together and whose
    clocks are one state, since a call costs milliseconds and a further key of it a fraction.
    A micro-batch writes the clocks of all keys of the buckets it touches: take more buckets for
    more shuffle partitions, or where micro-batches touch few of very many keys.  A checkpoint
    keeps its number of buckets.  With None, and for keys with members other than whole
    numbers, decimals, strings, booleans and dates, each key is a group by itself.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rule = make_rule(step_spec, seconds, iters, reset_index)
    out_schema = stream.schema
    if buckets is not None and not _plain(stream, keys):
        buckets = None

    def advance(_key: tuple, frames: Iterator[pd.DataFrame],
                state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        clocks: dict[str, Clock] = {}
        if state.exists:
            made_for, *known = state.get
            if made_for != (buckets or 0):
                raise ValueError(f"the checkpoint was made for {made_for} buckets, not {buckets or 0}")
            clocks = {i: Clock(*clock) for i, *clock in zip(*known)}
        codes, ids = pd.factorize(rows[_ID])
        times = rows[TIME].to_numpy()
        order = _in_order(rows, codes, times, ties)
        times = times[order]
        begins = np.flatnonzero(np.diff(codes[order], prepend=-1)).tolist()
        kept: list[int] = []
        for key_id, begin, end in zip(ids, begins, [*begins[1:], len(rows)]):
            clock = clocks.setdefault(key_id, Clock())
            kept += [begin + f for f in fire(times[begin:end], clock, rule)]
        state.update((
            buckets or 0, list(clocks), [c.position for c in clocks.values()],
            [c.last_index for c in clocks.values()], [c.last_micros for c in clocks.values()],
        ))
        if kept:
            yield rows.iloc[order[kept]][out_schema.names]

    timed = stream.withColumn(TIME, micros_of(stream, time)).where(F.col(TIME).isNotNull())
    if buckets is None:
        grouped = timed.withColumn(_ID, F.lit("")).groupBy(*columns(keys))
    else:
        written = [c.cast("string").alias(f"k{n}") for n, c in enumerate(columns(keys))]
        bucket = F.pmod(F.xxhash64(*columns(keys)), F.lit(buckets))
        grouped = timed.withColumns({_ID: F.to_json(F.struct(*written)), _BUCKET: bucket}).groupBy(_BUCKET)
    return grouped.applyInPandasWithState(
        advance, out_schema, _CLOCKS, "append", GroupStateTimeout.NoTimeout
    )


def _newest(spark: SparkSession, states: str, keys: list[str], entries: Sequence[Entry]) -> DataFrame:
    """The newest clock of each key in whole states and changes."""
    parts = [
        spark.read.parquet(f"{states}/{e.folder}").withColumn(_VERSION, F.lit(e.last).cast("bigint"))
        for e in entries
    ]
    if len(parts) == 1:
        return parts[0].drop(_VERSION)
    return latest_by_key(reduce(DataFrame.unionByName, parts), keys, [_VERSION]).drop(_VERSION)


def _since_whole(manifest: Manifest | None, number: int) -> list[Entry]:
    """What the clocks before micro-batch ``number`` are made of: a whole state, if one was
    written, and the changes after it."""
    earlier = [e for e in manifest.entries if e.last < number] if manifest else []
    whole = max((i for i, e in enumerate(earlier) if e.folder.startswith("whole=")), default=0)
    return earlier[whole:]


def _commit_clocks(spark: SparkSession, states: str, checkpoint: str, keys: list[str], changed: DataFrame,
                   number: int) -> None:
    """Write the clocks that a micro-batch changed and, every ``WHOLE_CLOCKS`` of them, all."""
    changed.write.mode("overwrite").parquet(f"{states}/changed={number}")
    manifest = commit(spark, states, checkpoint, Entry(number, number, f"changed={number}"))
    since = _since_whole(manifest, number + 1)
    if len(since) <= WHOLE_CLOCKS:
        return
    whole = Entry(since[0].first, number, f"whole={number}")
    _newest(spark, states, keys, since).write.mode("overwrite").parquet(f"{states}/{whole.folder}")
    # a micro-batch that comes again needs what was there before it
    write_manifest(spark, states, replace(manifest, entries=(*since, whole)))
    for entry in set(manifest.entries) - set(since):
        remove(spark, f"{states}/{entry.folder}")


def read_clocks(spark: SparkSession, states: str, keys: str | Sequence[str]) -> tuple[int, DataFrame | None]:
    """(number of the newest micro-batch, clocks of all keys) that a throttle job left."""
    manifest = read_manifest(spark, states)
    if manifest is None:
        return -1, None
    keys = [keys] if isinstance(keys, str) else list(keys)
    since = _since_whole(manifest, manifest.last + 1)
    return manifest.last, _newest(spark, states, keys, since)


def throttle_job(stream: DataFrame, keys: str | Sequence[str], time: str, checkpoint: str,
                 out: str, states: str, ties: Sequence[str] = (), step_spec: str = "::",
                 seconds: float | None = None, iters: int | None = None,
                 reset_index: bool = True, max_key_rows: int | None = MAX_KEY_ROWS,
                 trigger: dict | None = None,
                 merge_batches: int | None = MERGE_BATCHES) -> StreamingQuery:
    """Throttle a stream with the batch operator, hot keys spread over many tasks.

    Fired rows go to ``out`` (see ``read_batches``).  Under ``states`` each micro-batch writes the
    clocks of its own keys, and every tenth those of all keys (see ``read_clocks``).  A
    micro-batch that is delivered again starts from the same clocks and overwrites both.
    Both folders belong to the checkpoint; with another the job refuses to start.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rule = make_rule(step_spec, seconds, iters, reset_index)
    claim(stream.sparkSession, out, checkpoint, "batch")
    claim(stream.sparkSession, states, checkpoint, "changed")

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        since = _since_whole(read_manifest(spark, states), number)
        with temporary_stages(spark):
            clocks = None
            if since:
                own = batch.select(key_struct(keys).alias(KEY)).distinct()
                known = _newest(spark, states, keys, since)
                clocks = stage(known.join(own, key_struct(keys) == F.col(KEY), "left_semi"), "clocks")
            fired = stage(fired_rows(batch, keys, time, ties, rule, max_key_rows, clocks), "fired")
            changed = advanced_clocks(batch, fired, keys, time, rule, clocks)
            _commit_clocks(spark, states, checkpoint, keys, changed, number)
            store_batch(fired.drop(TIME, POSITION), number, out, checkpoint, merge_batches)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_weighted_mean(stream: DataFrame, keys: str | Sequence[str], value: str,
                         weight: Column | str | float, order: Sequence[str]) -> DataFrame:
    """Running mean and last value per key over all input so far; update mode."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return stream.groupBy(*columns(keys)).agg(
        weighted_mean(value, weight).alias("avg"), last_value(value, *order).alias("last")
    )
