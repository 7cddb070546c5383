"""Packing of documents into sequences: large-item matching, then best fit.

The number of sequences and what each holds depend only on how many pieces have each length,
a table of at most ``capacity`` rows whatever the corpus.  The driver plans on those counts;
a plan says, for a run of equally long pieces, which run of sequences takes them and where.
Spark numbers the pieces of each length and looks their places up.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.encoding import encoder, tokenizer_json
from cadence.runtime import stage

Run = tuple[int, int, int, int, int]
"""length, first number among the pieces of that length, pieces, first sequence, offset."""


class _Bins:
    """Open sequences by gap; those with one gap and fill are kept as runs (first, count)."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.by_gap: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.gaps: list[int] = []

    def put(self, gap: int, first: int, count: int) -> None:
        if gap not in self.by_gap:
            bisect.insort(self.gaps, gap)
        self.by_gap[gap].append((first, count))

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """A run of at most ``most`` sequences with the smallest gap that takes ``length``."""
        at = bisect.bisect_left(self.gaps, length)
        if at == len(self.gaps):
            return None
        gap = self.gaps[at]
        runs = self.by_gap[gap]
        first, count = runs.pop()
        if count > most:
            runs.append((first + most, count - most))
            count = most
        if not runs:
            del self.by_gap[gap]
            del self.gaps[at]
        return gap, first, count

    def new(self, count: int) -> int:
        first, self.next = self.next, self.next + count
        return first


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Places for ``counts[length]`` pieces of each length up to ``capacity``.

    Lengths above a third of the capacity: the longest left takes the longest other that fits
    beside it, so a sequence gets two of them at most.  Shorter ones, longest first, go where
    the least room is left that suffices, else into new sequences, as if placed one by one.
    """
    bins, runs, used = _Bins(capacity), [], defaultdict(int)

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], count, first, offset))
        used[length] += count

    large = {n: c for n, c in counts.items() if 3 * n > capacity and c}
    lengths = sorted(large)
    while lengths:
        length = lengths[-1]
        at = bisect.bisect_right(lengths, capacity - length) - 1
        if at < 0:  # nothing large fits beside it
            count = large[length]
            first = bins.new(count)
            place(length, count, first, 0)
        else:
            other = lengths[at]
            if other == length:
                count = large[length] // 2
                if not count:  # a single one is left
                    lengths.remove(length)
                    if lengths:
                        other, count = lengths[-1], 1
                        large[other] -= 1
                    first = bins.new(1)
                    place(length, 1, first, 0)
                    gap = capacity - length
                    if count:
                        place(other, 1, first, length)
                        gap -= other
                        if not large[other]:
                            lengths.remove(other)
                    bins.put(gap, first, 1)
                    continue
                large[length] -= count
            else:
                count = min(large[length], large[other])
                large[other] -= count
                if not large[other]:
                    lengths.remove(other)
            first = bins.new(count)
            place(length, count, first, 0)
            place(other, count, first, length)
        large[length] -= count
        gap = capacity - length - (other if at >= 0 else 0)
        if not large[length]:
            lengths.remove(length)
        bins.put(gap, first, count)

    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        left = counts[length]
        while left:
            found = bins.take(length, left)
            if found is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for count, pieces in ((full, each), (1 if rest else 0, rest)):
                    if count:
                        first = bins.new(count)
                        for k in range(pieces):
                            place(length, count, first, k * length)
                        bins.put(capacity - pieces * length, first, count)
                left = 0
            else:
                # a sequence that has taken one has the least room of those that take another
                gap, first, count = found
                each = gap // length
                full = min(count, left // each)
                rest = left - full * each if full < count else 0
                for sequences, pieces, at in ((full, each, first), (1 if rest else 0, rest, first + full)):
                    if sequences:
                        for k in range(pieces):
                            place(length, sequences, at, capacity - gap + k * length)
                        bins.put(gap - pieces * length, at, sequences)
                used_up = full + (1 if rest else 0)
                if used_up < count:
                    bins.put(gap, first + used_up, count - used_up)
                left -= full * each + rest
    return runs


def _pieces(spec: str, capacity: int, end_id: int, keys: int):
    """Batches of (keys..., text) to pieces with their number among the task's of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(spec), np.array([end_id], "<u4").tobytes()
        part, seen, width = TaskContext.get().partitionId(), defaultdict(int), 4 * capacity
        for batch in batches:
            rows, piece, start, length, number, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(keys)):
                data = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(data), width)):
                    part_ids = data[at:at + width]
                    n = len(part_ids) // 4
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(n)
                    number.append(seen[n])
                    seen[n] += 1
                    ids.append(part_ids)
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(keys)]
            yield pa.RecordBatch.from_arrays([
                *taken, pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array([part] * len(rows), pa.int32()),
                pa.array(number, pa.int64()), pa.array(ids, pa.binary()),
            ], [*[f"key_{k}" for k in range(keys)],
                "piece", "start", "length", "part", "number", "ids"])

    return cut


def _places(runs: list[Run], columns: list[str]):
    """Batches with ``length`` and ``number`` (over all pieces of that length) to places."""
    by_length: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_length[run[0]].append(run)
    table = {
        n: tuple(np.array(x, np.int64) for x in zip(*[r[1:] for r in own]))
        for n, own in by_length.items()
    }

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros((2, len(length)), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                first, _, where, at = table[n]
                run = np.searchsorted(first, number[own], side="right") - 1
                sequence[own] = where[run] + number[own] - first[run]
                offset[own] = at[run]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    return look_up


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
    key_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as the method finds.

    Returns the key columns and ``piece, start, length, ids`` (bytes, little-endian unsigned
    32 bits), ``sequence_id`` and ``offset``.  A document is its ids and ``end_id``; only those
    longer than ``capacity`` are cut, into pieces of that size and a rest.  A null or empty
    text is one piece, its end id.  Keys may be null; repeated rows are packed repeatedly;
    other columns are ignored, an empty table gives no rows.

    Pieces are written once to the staging folder, with a number among those of the same
    length and task; numbers over all tasks follow from the counts per task and length, which
    are joined as one row of at most ``capacity`` numbers per task.
    """
    spark, keys = docs.sparkSession, len(key_cols)
    kinds = [docs.schema[c].dataType.simpleString() for c in key_cols]
    schema = ", ".join(
        [*[f"key_{k} {kind}" for k, kind in enumerate(kinds)], "piece int", "start bigint",
         "length bigint", "part int", "number bigint", "ids binary"]
    )
    spec = tokenizer_json(tokenizer)
    pieces = stage(
        docs.select(*key_cols, text_col)
        .mapInArrow(_pieces(spec, capacity, end_id, keys), schema), "pieces",
    )
    counted = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("own")), "counts")
    counts = {  # at most `capacity` rows
        r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("own").alias("n")).collect()
    }
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # one row per task, with as many numbers as there are lengths
    before = (
        counted.withColumn("before", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
        .groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("m"))
        .select(F.col("part").alias("of"), F.transform(
            F.sequence(F.lit(0), F.lit(capacity)), lambda n: F.element_at("m", n.cast("bigint"))).alias("before"))
    )
    numbered = pieces.join(before, F.col("part") == F.col("of")).withColumn(
        "number", F.get("before", F.col("length").cast("int")) + F.col("number")
    )
    names = [*[f"key_{k}" for k in range(keys)], "piece", "start", "length", "ids"]
    placed = numbered.select(*names, "number").mapInArrow(
        _places(plan(counts, capacity), names),
        ", ".join([*[f"key_{k} {kind}" for k, kind in enumerate(kinds)], "piece int",
                   "start bigint", "length bigint", "ids binary", "sequence_id bigint",
                   "offset bigint"]),
    )
    return placed.withColumnsRenamed({f"key_{k}": c for k, c in enumerate(key_cols)})
