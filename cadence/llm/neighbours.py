"""Each row together with the row that follows it in the order of an id."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

LEAST, GREATEST = -(1 << 63), (1 << 63) - 1  # null ids stand at the least place


class Cuts:
    """Where the ranges of (id, tie) end.

    Quantiles of the ids cut between ids.  An id that several quantiles name holds several
    shares of the rows; it is cut by its ties, which are hashes and hence evenly spread.
    """

    def __init__(self, quantiles: list[float]):
        ids, ties = [], []
        for value, times in sorted(Counter(quantiles).items()):
            ids += [value] * times
            ties += [LEAST + j * ((1 << 64) // times) for j in range(1, times)] + [GREATEST]
        self.ids, self.ties = np.array(ids, np.float64), np.array(ties, np.int64)

    def ranges(self, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        ids = ids.astype(np.float64)
        low = np.searchsorted(self.ids, ids)
        several = np.searchsorted(self.ids, ids, side="right") - low > 1
        for at in np.unique(low[several]).tolist():
            own = several & (low == at)
            end = int(np.searchsorted(self.ids, self.ids[at], side="right"))
            low[own] = at + np.searchsorted(self.ties[at:end], ties[own])
        return low


def _targets(cuts: Cuts, firsts: dict[int, tuple[tuple[int, int], int]]):
    """The range of each row and, for the first of a range, the range before."""

    @F.arrow_udf("array<int>")
    def targets(place: pa.Array, tie: pa.Array) -> pa.Array:
        ids, ties = (c.to_numpy(zero_copy_only=False) for c in (place, tie))
        out = []
        for id_, t, own in zip(ids.tolist(), ties.tolist(), cuts.ranges(ids, ties).tolist()):
            least, before = firsts[own]
            out.append([own, before] if (id_, t) == least else [own])
        return pa.array(out, pa.list_(pa.int32()))

    return targets


def map_with_next(
    rows: DataFrame, id_col: str, fn: Callable[[Iterator[tuple[tuple, tuple]]], Iterator[tuple]],
    schema: str, batch_rows: int = 1000,
) -> DataFrame:
    """Apply ``fn`` to an iterator of (row, next row) tuples of each range of ids.

    ``fn`` yields one tuple of ``schema`` per pair.  Order is by ``id_col`` (an integer; null
    ids first), then by a hash of the other columns and by these; after the last row comes the
    first, and a single row follows itself.  Repeated rows follow each other.  An empty table
    gives no rows.

    One shuffle deals the rows by ranges of the id, cut at approximate quantiles, one range per
    shuffle partition; an id with a large share of the rows, or rows without one, are cut by the
    hash as well.  The first row of each range also goes to the range before it.  The driver sees
    the cuts and the first place of each range.  Rows stream through ``fn``, so memory holds a
    batch, not a range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    others = [c for c in rows.columns if c != id_col]
    numbered = rows.select(id_col, *others).toDF("id", *(f"v{k}" for k in range(len(others))))
    numbered = numbered.withColumns({
        "place": F.coalesce(F.col("id").cast("bigint"), F.lit(LEAST)),
        "tie": F.xxhash64(*numbered.columns[1:]) if others else F.lit(0).cast("bigint"),
    })
    shares = [k / parts for k in range(1, parts)]
    cuts = Cuts(numbered.approxQuantile("place", shares, 1 / (4 * parts)) if shares else [])

    @F.arrow_udf("int")
    def range_of(place: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(cuts.ranges(*(c.to_numpy(zero_copy_only=False) for c in (place, tie))), pa.int32())

    found = sorted(
        (r["range"], tuple(r["least"]))
        for r in numbered.select("place", "tie").withColumn("range", range_of("place", "tie"))
        .groupBy("range").agg(F.min(F.struct("place", "tie")).alias("least")).collect()
    )
    firsts = {
        own: (least, found[k - 1][0]) for k, (own, least) in enumerate(found)
    }
    values = [f"v{k}" for k in range(len(others))]
    dealt = (
        numbered.select("*", F.posexplode(_targets(cuts, firsts)("place", "tie")).alias("copy", "range"))
        .repartitionById(parts, "range").sortWithinPartitions("range", "copy", "place", "tie", *values)
        .select("range", "copy", "id", *values)
    )

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        """Neighbours; the last own row of a range meets the first of the copies after it."""
        last, last_range = None, None
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for k in range(batch.num_rows):
                row = tuple(c[k].as_py() for c in columns)
                if last is not None:
                    if row[0] != last_range:
                        raise RuntimeError(f"no row follows the last of range {last_range}")
                    yield last, row[2:]
                    last = None
                if not row[1]:
                    last, last_range = row[2:], row[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for made in fn(pairs(batches)):
            held.append(made)
            if len(held) == batch_rows:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple[Any, ...]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
