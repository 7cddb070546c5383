"""Row positions and batches over a global order, without a single-task window.

Rows are range-partitioned on the full order, sorted inside each partition and written
to the staging folder together with their partition number and slot.  The written
layout is what makes the numbering stable: it cannot move when a task is run again.
Every other quantity is one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.runtime import quoted, stage

PART = "__part"
SLOT = "__slot"
KEY = "__key"
TOTAL = "__total"

_SLOT_MASK = (1 << 33) - 1  # low bits of monotonically_increasing_id


def columns(names: str | Sequence[str | Column]) -> list[Column]:
    if isinstance(names, (str, Column)):
        names = [names]
    return [F.col(quoted(n)) if isinstance(n, str) else n for n in names]


def key_struct(keys: Sequence[str]) -> Column:
    """Keys as one struct, whose equality also holds between NULL members."""
    return F.struct(*columns(keys))


def lay_out(df: DataFrame, order: Sequence[str | Column], label: str) -> DataFrame:
    """Stage ``df`` sorted by ``order``, adding partition number and slot in it."""
    order = columns(order)
    return stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(PART, F.spark_partition_id())
        .withColumn(SLOT, F.monotonically_increasing_id().bitwiseAND(F.lit(_SLOT_MASK))),
        label,
    )


def part_offsets(laid_out: DataFrame) -> DataFrame:
    """One row per partition: its row count, the rows before it and the total."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        laid_out.groupBy(PART)
        .agg(F.count("*").alias("__rows"))
        .withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .withColumn(TOTAL, F.sum("__rows").over(everything))
    )


def _indexed(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    laid_out = lay_out(df, order, "ordered")
    # one row per partition, so its size is bounded by the partition count
    offsets = F.broadcast(part_offsets(laid_out).drop("__rows"))
    return (
        laid_out.join(offsets, PART)
        .withColumn(name, F.col("__before") + F.col(SLOT))
        .drop(PART, SLOT, "__before")
    )


def dense_index(df: DataFrame, order: str | Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Add the 0-based position of every row in ``order`` (make it total: add ties)."""
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return _indexed(df, order, name).drop(TOTAL)


def balanced_batches(df: DataFrame, order: str | Sequence[str | Column], max_size: int,
                     name: str = "batch_id", index: str | None = None) -> DataFrame:
    """Cut the order into the fewest consecutive batches of at most ``max_size`` rows.

    Sizes differ by at most one and larger batches come first.
    """
    if max_size < 1:
        raise ValueError("max_size must be positive")
    order = [order] if isinstance(order, (str, Column)) else list(order)
    position = index or "__idx"
    out = _indexed(df, order, position).withColumn(
        name, batch_of(F.col(quoted(position)), F.col(TOTAL), max_size)
    )
    return out.drop(TOTAL) if index else out.drop(TOTAL, position)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def batch_of(index: Column, total: Column, max_size: int) -> Column:
    """Batch number of position ``index`` among ``total`` rows."""
    batches = _div(total - 1, F.lit(max_size)) + 1
    longer, size = total % batches, _div(total, batches)
    in_longer = longer * (size + 1)
    return F.when(index < in_longer, _div(index, size + 1)).otherwise(
        longer + _div(index - in_longer, size)
    )


def batch_bounds(total: int, max_size: int) -> list[tuple[int, int]]:
    """Same cut as position ranges [start, end)."""
    if total == 0:
        return []
    batches = (total - 1) // max_size + 1
    size, longer = divmod(total, batches)
    starts = [b * size + min(b, longer) for b in range(batches + 1)]
    return list(zip(starts, starts[1:]))


def inside_key(keys: Sequence[str]) -> Window:
    """Rows of one key in one partition of the layout, in order."""
    return Window.partitionBy(PART, *columns(keys)).orderBy(SLOT)


def with_carries(laid_out: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """Add ``<name>_before`` and ``<name>_all`` for keys that lie in several partitions.

    They hold the sum over the key's rows in earlier partitions and in all; a key inside one
    partition has NULLs.  The rows lie in key order, so only the first and the last key of a
    partition can go beyond it: what is broadcast is at most two rows per partition.
    """
    pieces = laid_out.groupBy(F.col(PART).alias("__p"), key_struct(keys).alias(KEY)).agg(
        *(c.alias(n) for n, c in sums.items())
    )
    key = Window.partitionBy(KEY)
    earlier = key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    spread = (
        pieces.withColumn("__pieces", F.count("*").over(key))
        .withColumns({f"{n}_before": F.sum(n).over(earlier) for n in sums})
        .withColumns({f"{n}_all": F.sum(n).over(key) for n in sums})
        .where("__pieces > 1").drop("__pieces", *sums)
    )
    match = (F.col(PART) == F.col("__p")) & (key_struct(keys) == F.col(KEY))
    return laid_out.join(F.broadcast(spread), match, "left").drop("__p", KEY)


def _placed_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                   name: str) -> DataFrame:
    """Rows laid out by key, with the position in the key and the carries of row counts."""
    laid_out = lay_out(df, [*columns(keys), *columns(order)], "keyed")
    carried = with_carries(laid_out, keys, __rows=F.count("*"))
    before = F.coalesce(F.col("__rows_before"), F.lit(0))
    position = F.row_number().over(inside_key(keys)) - 1 + before
    return carried.withColumn(name, position.cast("bigint"))


def key_index(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
              name: str = "i") -> DataFrame:
    """Add the 0-based position of every row inside its key, whatever the key's size."""
    return _placed_in_key(df, keys, order, name).drop(PART, SLOT, "__rows_before", "__rows_all")


def key_batches(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], max_size: int,
                name: str = "batch_id") -> DataFrame:
    """``balanced_batches`` inside each key: batch numbers start at 0 for every key."""
    if max_size < 1:
        raise ValueError("max_size must be positive")
    here = Window.partitionBy(PART, *columns(keys))
    placed = _placed_in_key(df, keys, order, "__idx").withColumn(
        TOTAL, F.coalesce(F.col("__rows_all"), F.count("*").over(here))
    )
    batch = batch_of(F.col("__idx"), F.col(TOTAL), max_size)
    return placed.withColumn(name, batch).drop(
        PART, SLOT, "__rows_before", "__rows_all", "__idx", TOTAL
    )
