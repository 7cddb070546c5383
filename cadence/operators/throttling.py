"""Throttle: keep the rows at which "enough has happened since the last firing".

A row fires when the step spec matches its position in the key, or ``iters`` positions
or ``seconds`` have passed since the last firing.  Three ways compute it:

* without ``seconds`` the answer follows from the position alone;
* ordinary keys are scanned in sorted partitions, the state being one pair of numbers;
* a hot key is spread over many tasks: every row gets a link to the row that would fire
  next if it fired.  Blocks of rows are followed each in its task, from wherever a
  firing can enter; the true entries are then found by doubling the hops between blocks,
  in a number of joins logarithmic in the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadence.functions.steps import StepSpec, next_step, previous_step, step_filter, step_spec
from cadence.operators.ordering import KEY, columns, dense_index, key_index, key_struct
from cadence.runtime import stage

TIME = "__micros"
POSITION = "__position"
_LOCAL = "__pos"
_FIRST = "__first_of_key"
# A key with more rows than this is split over tasks instead of scanned by one.
MAX_KEY_ROWS = 5_000_000
# Consecutive rows of a hot key that one task follows.
BLOCK_ROWS = 1 << 18
# Clock columns: rows counted, position of the last firing, time of the last firing.
CLOCK = ("clock_position", "clock_last_index", "clock_last_micros")


@dataclass(frozen=True)
class Rule:
    spec: StepSpec
    micros: int | None
    iters: int | None
    reset_index: bool


@dataclass
class Clock:
    """Scan state of one key: next position, position and time of the last firing."""

    position: int = 0
    last_index: int = -1
    last_micros: int | None = None


def make_rule(step_text: str, seconds: float | None, iters: int | None, reset_index: bool) -> Rule:
    if iters is not None and iters < 1:
        raise ValueError("iters must be positive")
    if seconds is not None and seconds <= 0:
        raise ValueError("seconds must be positive")
    micros = None if seconds is None else round(seconds * 1_000_000)
    return Rule(step_spec(step_text), micros, iters, reset_index)


def micros_of(df: DataFrame, time: str) -> Column:
    """Time column in microseconds; plain numbers are taken as seconds.

    Timestamps without a zone are counted on the wall clock, whatever the session's zone.
    """
    dtype = df.schema[time].dataType
    column = columns(time)[0]
    if isinstance(dtype, T.DateType):
        dtype, column = T.TimestampNTZType(), column.cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampNTZType):
        since = column - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        seconds = since.cast("interval second").cast("decimal(20,6)")
        return (seconds * 1_000_000).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column)
    return F.round(column * 1_000_000).cast("bigint")


def fire(times: np.ndarray, clock: Clock, rule: Rule) -> list[int]:
    """Offsets that fire among the next rows of a key; moves the clock past them.

    Every row is linked to the one that fires next if it does, then the links are followed.
    """
    size, start = len(times), clock.position
    offsets = np.arange(size)
    first, links = size, np.full(size, size)
    if rule.micros is not None:
        links = np.searchsorted(times, times + rule.micros)
        first = 0
        if clock.last_micros is not None:
            first = int(np.searchsorted(times, clock.last_micros + rule.micros))
    if rule.iters is not None:
        free = clock.last_index + rule.iters - start
        first = min(first, max(free, 0))
        onward = offsets + rule.iters if rule.reset_index else np.maximum(offsets + 1, free)
        links = np.minimum(links, onward)
    if not rule.spec.never:
        hits = np.where(rule.spec.fires_at(start + offsets), offsets, size)
        upcoming = np.minimum.accumulate(np.append(hits, size)[::-1])[::-1]
        first, links = min(first, int(upcoming[0])), np.minimum(links, upcoming[1:])
    fired = []
    step = links.tolist()
    while first < size:
        fired.append(first)
        first = step[first]
    if fired:
        clock.last_micros = int(times[fired[-1]])
        if rule.reset_index:
            clock.last_index = start + fired[-1]
    clock.position += size
    return fired


def _start(batch: pa.RecordBatch, at: int) -> Clock:
    """Clock of the key whose rows begin at offset ``at``; fresh without clock columns."""
    if CLOCK[0] not in batch.schema.names:
        return Clock()
    return Clock(*(batch.column(c)[at].as_py() for c in CLOCK))


def _scanner(rule: Rule):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clock = Clock()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            times = batch.column(TIME).to_numpy()
            starts = np.flatnonzero(batch.column(_FIRST).to_numpy(zero_copy_only=False)).tolist()
            fresh = set(starts)
            begins = starts if 0 in fresh else [0, *starts]  # a key may go on from the last batch
            kept: list[int] = []
            positions: list[int] = []
            for begin, end in zip(begins, [*begins[1:], batch.num_rows]):
                if begin in fresh:
                    clock = _start(batch, begin)
                first = clock.position
                fired = fire(times[begin:end], clock, rule)
                kept += [begin + f for f in fired]
                positions += [first + f for f in fired]
            if kept:
                rows = batch.take(pa.array(kept, pa.int64()))
                rows = rows.drop_columns([c for c in (*CLOCK, _FIRST) if c in rows.schema.names])
                yield rows.append_column(POSITION, pa.array(positions, pa.int64()))

    return scan


def _scan_keys(df: DataFrame, keys: Sequence[str], order: list[Column], rule: Rule) -> DataFrame:
    kept = [f for f in df.schema if f.name not in CLOCK]
    # the window leaves each key's rows together and in order, and says where a key begins
    # by Spark's own equality, under which NaN equals NaN and structs compare by member
    in_key = Window.partitionBy(*columns(keys)).orderBy(*order)
    return df.withColumn(_FIRST, F.row_number().over(in_key) == 1).mapInArrow(
        _scanner(rule), T.StructType(kept).add(POSITION, T.LongType())
    )


def _split_hot(df: DataFrame, keys: Sequence[str],
               max_key_rows: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Separate the rows of keys too large for one task: (ordinary rows, hot rows).

    There are at most rows / ``max_key_rows`` hot keys, so Spark may broadcast their list if
    it is small.  Counting reads the key columns once more; ``max_key_rows=None`` says no key
    is hot.
    """
    if max_key_rows is None:
        return df, None
    hot_keys = stage(
        df.groupBy(*columns(keys)).agg(F.count("*").alias("__rows"))
        .where(F.col("__rows") > max_key_rows)
        .select(key_struct(keys).alias(KEY)),
        "hot-keys",
    )
    if hot_keys.isEmpty():
        return df, None
    match = key_struct(keys) == F.col(KEY)
    return df.join(hot_keys, match, "left_anti"), df.join(hot_keys, match, "left_semi")


def _due(step: Column, rule: Rule, position: Column, last_index: Column) -> list[Column]:
    """Positions after ``step`` at which spec or ``iters`` fire, counted inside the batch.

    ``position`` is what the key's clock had counted before; ``last_index`` is the last
    firing, counted from the key's beginning.
    """
    found = []
    if rule.iters is not None:
        since = last_index if rule.reset_index else F.lit(-1).cast("bigint")
        found.append(F.greatest(step + 1, since + rule.iters - position))
    if not rule.spec.never:
        found.append(next_step(step + position, rule.spec) - position)
    return found


def _earliest(choices: list[Column]) -> Column:
    return F.least(*choices) if len(choices) > 1 else choices[0]


def _link(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(key, position, position that fires next if this one does)."""
    # Merge each row with its due time into one order: a due time's position there,
    # less the due times before it (as many as its row's position), counts the rows
    # before it, which is the position of the first row not earlier.
    rows = nodes.select(KEY, _LOCAL, F.col(TIME).alias("__at"), F.lit(1).alias("__kind"), CLOCK[0])
    due = nodes.select(
        KEY, _LOCAL, (F.col(TIME) + rule.micros).alias("__at"), F.lit(0).alias("__kind"), CLOCK[0]
    )
    merged = dense_index(rows.unionByName(due), [KEY, "__at", "__kind", _LOCAL], "__merged")
    firsts = merged.groupBy(F.col(KEY).alias("__k")).agg(
        F.min("__merged").alias("__first"), F.sum("__kind").alias("__n")
    )
    step, position = F.col(_LOCAL), F.col(CLOCK[0])
    by_time = F.col("__merged") - F.col("__first") - step
    return (
        merged.where("__kind = 0")
        .join(F.broadcast(firsts), F.col(KEY) == F.col("__k"))
        .withColumn("__next", _earliest([by_time, *_due(step, rule, position, step + position)]))
        .where(F.col("__next") < F.col("__n"))
        .select(KEY, _LOCAL, "__next")
    )


def _first_firing(nodes: DataFrame, rule: Rule) -> DataFrame:
    """(key, position) of the first row of the batch that fires, given the clocks."""
    last = F.col(CLOCK[2])
    in_time = last.isNull() | (F.col(TIME) >= last + rule.micros)
    per_key = nodes.groupBy(KEY).agg(
        F.min(F.when(in_time, F.col(_LOCAL))).alias("__by_time"), F.count("*").alias("__n"),
        *(F.max(c).alias(c) for c in CLOCK),
    )
    none = F.lit(-1).cast("bigint")
    others = _due(none, rule, F.col(CLOCK[0]), F.col(CLOCK[1]))
    return (
        per_key.withColumn(_LOCAL, _earliest([F.col("__by_time"), *others]))
        .where(F.col(_LOCAL) < F.col("__n"))
        .select(KEY, _LOCAL)
    )


def _reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """All (key, position) reached from ``starts``; each round doubles the reach."""
    reached = starts
    while True:
        ahead = stage(
            reached.join(links, [KEY, _LOCAL]).select(KEY, F.col("__next").alias(_LOCAL)), "reached"
        )
        if ahead.isEmpty():
            return reached
        reached = reached.unionByName(ahead)
        onward = links.select(
            F.col(KEY).alias("__k"), F.col(_LOCAL).alias("__mid"), F.col("__next").alias("__far")
        )
        links = stage(
            links.join(onward, (F.col(KEY) == F.col("__k")) & (F.col("__next") == F.col("__mid")))
            .select(KEY, _LOCAL, F.col("__far").alias("__next")),
            "links",
        )


def _exits(block_rows: int):
    """From where a firing can enter a block to where it is once it left the block."""

    def exits(block: pa.Table) -> pa.Table:
        block = block.sort_by(_LOCAL)
        position, following = (block.column(c).to_numpy() for c in (_LOCAL, "__next"))
        base = block.column("__block")[0].as_py() * block_rows
        if position[0] >= base:
            return block.slice(0, 0).select([KEY, _LOCAL, "__next"])
        # The first row is the one before the block.  Links never cross, so a firing
        # enters no later than that row's link leads to.
        target = following[1:] - base
        entered = min(len(target), int(following[0]) - base + 1)
        inside = target < len(target)
        while inside.any():
            target[inside] = target[target[inside]]
            inside = target < len(target)
        found = block.slice(1, entered).select([KEY, _LOCAL])
        return found.append_column("__next", pa.array(target[:entered] + base))

    return exits


def _walk(block_rows: int):
    """Rows of a block that fire; the rows with a negative link are its entries."""

    def walk(block: pa.Table) -> pa.Table:
        position, following = (block.column(c).to_numpy() for c in (_LOCAL, "__next"))
        links = following >= 0
        step = dict(zip(position[links].tolist(), following[links].tolist()))
        end = (block.column("__block")[0].as_py() + 1) * block_rows
        fired: set[int] = set()
        for at in position[~links].tolist():
            while at is not None and at < end and at not in fired:
                fired.add(at)
                at = step.get(at)
        key = block.column(KEY).take(pa.array([0] * len(fired), pa.int64()))
        return pa.table({KEY: key, _LOCAL: pa.array(sorted(fired), pa.int64())})

    return walk


def _fired_positions(links: DataFrame, starts: DataFrame, block_rows: int) -> DataFrame:
    """(key, position) of all firings, in blocks of consecutive rows of a key.

    Inside a block the links are followed at once; only the hops from block to block
    need joins.  A block is bounded, so no task holds more than one block of a key.
    """
    linked = T.StructType([f for f in links.schema if f.name in (KEY, _LOCAL, "__next")])
    size, none = F.lit(block_rows), F.lit(-1).cast("bigint")
    block = F.call_function("div", F.col(_LOCAL), size)
    before = starts.select(KEY, none.alias(_LOCAL), F.col(_LOCAL).alias("__next"))
    own = links.withColumn("__block", block)
    lead = (
        links.unionByName(before).where((F.col(_LOCAL) + 1) % size == 0)
        .withColumn("__block", F.call_function("div", F.col(_LOCAL) + 1, size))
    )
    hops = own.unionByName(lead).groupBy(KEY, "__block").applyInArrow(_exits(block_rows), linked)
    entries = _reachable(stage(hops, "hops"), starts)
    marked = entries.withColumn("__next", none).withColumn("__block", block)
    return (
        own.unionByName(marked).groupBy(KEY, "__block")
        .applyInArrow(_walk(block_rows), T.StructType(linked.fields[:2]))
    )


def _split_keys(hot: DataFrame, keys: Sequence[str], order: list[Column], rule: Rule) -> DataFrame:
    placed = stage(
        key_index(hot, keys, order, _LOCAL).withColumn(KEY, key_struct(keys)), "placed"
    )
    nodes = placed.select(KEY, _LOCAL, TIME, *CLOCK)
    starts = stage(_first_firing(nodes, rule), "starts")
    fired = _fired_positions(stage(_link(nodes, rule), "links"), starts, BLOCK_ROWS)
    return (
        placed.join(fired, [KEY, _LOCAL], "left_semi")
        .withColumn(POSITION, F.col(_LOCAL) + F.col(CLOCK[0]))
        .drop(KEY, _LOCAL, *CLOCK)
    )


def _by_position(df: DataFrame, keys: Sequence[str], order: list[Column], rule: Rule) -> DataFrame:
    placed = key_index(df, keys, order, _LOCAL).withColumn(
        POSITION, F.col(_LOCAL) + F.col(CLOCK[0])
    )
    fires = step_filter(POSITION, rule.spec)
    if rule.iters is not None and rule.reset_index:
        restart = F.greatest(previous_step(POSITION, rule.spec), F.col(CLOCK[1]))
        fires = fires | ((F.col(POSITION) - restart) % rule.iters == 0)
    elif rule.iters is not None:
        fires = fires | (F.col(POSITION) + 1 >= rule.iters)
    return placed.where(fires).drop(_LOCAL, *CLOCK)


def _with_clocks(df: DataFrame, keys: Sequence[str], clocks: DataFrame | None) -> DataFrame:
    """Rows with the clock of their key from before; a fresh one where there is none."""
    fresh = dict(zip(CLOCK, (F.lit(0), F.lit(-1), F.lit(None))))
    if clocks is None:
        return df.withColumns({c: v.cast("bigint") for c, v in fresh.items()})
    known = clocks.select(key_struct(keys).alias(KEY), *(F.col(c).alias(f"k{c}") for c in CLOCK))
    joined = df.join(known, key_struct(keys) == F.col(KEY), "left")
    found = (F.coalesce(F.col(f"k{c}"), v).cast("bigint").alias(c) for c, v in fresh.items())
    return joined.select(*columns(df.columns), *found)


def fired_rows(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str | Column],
               rule: Rule, max_key_rows: int | None, clocks: DataFrame | None = None) -> DataFrame:
    """Rows that fire, with their time in microseconds and position in the key."""
    order = [*columns(time), *columns(ties)]
    timed = df.withColumn(TIME, micros_of(df, time)).where(order[0].isNotNull())
    timed = _with_clocks(timed, keys, clocks)
    if rule.micros is None:
        return _by_position(timed, keys, order, rule)
    ordinary, hot = _split_hot(timed, keys, max_key_rows)
    if clocks is None:
        ordinary = ordinary.drop(*CLOCK)  # constants need not travel to Python
    fired = _scan_keys(ordinary, keys, order, rule)
    if hot is None:
        return fired
    return fired.unionByName(_split_keys(hot, keys, order, rule))


def advanced_clocks(rows: DataFrame, fired: DataFrame, keys: Sequence[str], time: str, rule: Rule,
                    clocks: DataFrame | None) -> DataFrame:
    """Clocks (keys..., position, last index, last time) of the keys of ``rows``, after them.

    The last firing is that of the greatest position, whatever its time: rows that come late
    can fire at an earlier time than the firing before.  Inside one call times only grow.
    """
    none = F.lit(None).cast("bigint")
    counted = rows.where(columns(time)[0].isNotNull()).select(
        *columns(keys), F.lit(1).cast("bigint").alias(CLOCK[0]), none.alias(CLOCK[1]), none.alias(CLOCK[2])
    )
    last = F.col(POSITION) if rule.reset_index else none
    latest = fired.select(
        *columns(keys), F.lit(0).cast("bigint").alias(CLOCK[0]), last.alias(CLOCK[1]),
        F.col(TIME).alias(CLOCK[2]),
    )
    changes = counted.unionByName(latest).groupBy(*columns(keys)).agg(
        F.sum(CLOCK[0]).alias(CLOCK[0]), F.max(CLOCK[1]).alias(CLOCK[1]), F.max(CLOCK[2]).alias(CLOCK[2])
    )
    before = _with_clocks(changes.withColumnsRenamed({c: f"c{c}" for c in CLOCK}), keys, clocks)
    return before.select(
        *columns(keys), (F.col(CLOCK[0]) + F.col(f"c{CLOCK[0]}")).alias(CLOCK[0]),
        *(F.coalesce(f"c{c}", c).alias(c) for c in CLOCK[1:]),
    )


def throttle(df: DataFrame, keys: str | Sequence[str], time: str,
             ties: Sequence[str | Column] = (), step_spec: str = "::",
             seconds: float | None = None, iters: int | None = None,
             reset_index: bool = True, max_key_rows: int | None = MAX_KEY_ROWS) -> DataFrame:
    """Rows that fire, per key, in the order of ``time`` and ``ties``.

    With ``seconds`` the first row of a key fires.  Rows without a time are left out.
    The position clock starts at -1, so ``iters=7`` fires at positions 6, 13, ...
    ``reset_index=False`` lets a firing reset the time clock only.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rule = make_rule(step_spec, seconds, iters, reset_index)
    return fired_rows(df, keys, time, ties, rule, max_key_rows).drop(TIME, POSITION)
