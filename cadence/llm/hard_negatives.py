"""Hard negatives of anchor rows by slots between their positives' scores.

Two passes go over the rows in blocks.  The first finds each anchor's positives.  Their scores,
the upper limits of the windows in which negatives are sought, split the scores into disjoint
slots; in the second pass each task combines the best rows per anchor and slot, and shuffles no
more than those.  From its own slot downward, the slots' best rows hold every window's answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordering import dense_index
from cadence.runtime import stage

GROUP_BYTES = 4 << 20
"""Vectors of the anchors that go to the tasks at a time; more anchors take several passes."""
ROWS, ANCHORS = 4096, 256
"""Rows and anchors of one matrix product."""
LARGEST = 1 << 50
"""Scores below this are exact in doubles, and leave room for a row's place beside them."""

_NONE = np.iinfo(np.int64).min
_FOUND = "anchor bigint, slot int, score bigint, row bigint, vec_id bigint"


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, zeros after a short one."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the ``k`` best allowed rows per anchor; earlier rows win ties."""
    n = scores.shape[1]
    ranked = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), _NONE)
    if k < n:
        at = np.argpartition(ranked, n - k, axis=1)[:, n - k:]
    else:
        at = np.broadcast_to(np.arange(n), ranked.shape)
    anchor, place = np.nonzero(np.take_along_axis(ranked, at, 1) != _NONE)
    return anchor, at[anchor, place]


class _Combiner:
    """The best rows per anchor and slot that a task has met."""

    def __init__(self, k: int):
        self.k, self.parts, self.size, self.trimmed = k, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > 2 * self.trimmed + (1 << 18):
            self.parts = [self.best()]
            self.size = self.trimmed = len(self.parts[0][0])

    def best(self) -> list[np.ndarray]:
        """Columns anchor, slot, score, row, id, null id."""
        if not self.parts:
            return [np.empty(0, np.int64)] * 6
        anchor, slot, score, row, id_, null = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((row, id_, null, -score, slot, anchor))
        edge = (np.diff(anchor[order]) != 0) | (np.diff(slot[order]) != 0)
        starts = np.flatnonzero(np.append(True, edge))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        order = order[place < self.k]
        return [c[order] for c in (anchor, slot, score, row, id_, null)]


def _scored(anchors: dict[str, np.ndarray], width: int, k: int, limits: np.ndarray | None, ratio: tuple[int, int]):
    """Batches of (row, vec_id, label, vector) to the best rows per anchor and slot.

    Without ``limits``: rows of the anchor's label in one slot.  With them, a matrix of falling
    upper limits per anchor (``_NONE`` where there are fewer): rows of other labels in the slot
    between a limit and the next, not below ``ratio`` of the limit.
    """

    def slots(scores: np.ndarray, same: np.ndarray, some: slice) -> Iterator[tuple[int, np.ndarray]]:
        if limits is None:
            yield 0, same
            return
        for slot in range(limits.shape[1]):
            upper = limits[some, slot, None]
            inside = (upper != _NONE) & ~same & (scores <= upper)
            inside &= ratio[1] * scores >= ratio[0] * np.where(upper == _NONE, 0, upper)
            if slot + 1 < limits.shape[1]:
                inside &= scores > limits[some, slot + 1, None]
            yield slot, inside

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Combiner(k)
        reach = np.abs(anchors["vectors"]).max(initial=0)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                block = batch.slice(at, ROWS)
                row = block.column(0).to_numpy()
                null = block.column(1).is_null().to_numpy(zero_copy_only=False)
                id_ = block.column(1).fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((row, id_, null))
                row, null, id_ = row[order], null[order], id_[order]
                label = block.column(2).to_numpy()[order]
                vectors = _matrix(block.column(3), width)[order]
                if width * reach * np.abs(vectors).max(initial=0) >= LARGEST:
                    raise ValueError("components are too large for exact scores")
                for start in range(0, len(anchors["row"]), ANCHORS):
                    some = slice(start, start + ANCHORS)
                    scores = (anchors["vectors"][some] @ vectors.T).astype(np.int64)
                    same = anchors["label"][some, None] == label
                    itself = anchors["row"][some, None] == row
                    for slot, allowed in slots(scores, same, some):
                        anchor, place = _best(scores, allowed & ~itself, k)
                        found.add(anchors["place"][some][anchor], np.full(len(anchor), slot),
                                  scores[anchor, place], row[place], id_[place], null[place])
        anchor, slot, score, row, id_, null = found.best()
        yield pa.RecordBatch.from_arrays([
            pa.array(anchor, pa.int64()), pa.array(slot.astype(np.int32)), pa.array(score, pa.int64()),
            pa.array(row, pa.int64()), pa.array(id_, pa.int64(), mask=null.astype(bool)),
        ], ["anchor", "slot", "score", "row", "vec_id"])

    return scored


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best rows per anchor and slot of all tasks, numbered from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(
        F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score is its inner product with the anchor, over components rounded down to whole
    numbers.  An anchor's positives are its ``positives`` best other rows of the same label.  For
    each, the best ``negatives`` rows of other labels are returned whose score is at most the
    positive's and at least ``ratio[0] / ratio[1]`` of it.  Equal scores are ordered by id, null
    ids last, then by a written row number.

    Rows with a null label or vector, or a null or non-finite component, take no part.  Rows that
    repeat an id are rows of their own, also as anchors.  A short vector counts as continued by
    zeros; scores that 64-bit numbers do not hold exactly are an error.  An anchor without another
    row of its label, and an empty table, give no rows; other columns are ignored.

    Anchors go to the tasks in groups of ``GROUP_BYTES``, so many passes over the rows are made as
    there are groups.  A task sends on at most ``positives`` rows per anchor in the first pass, and
    ``negatives`` per anchor and slot in the second.
    """
    id_, vector, label = (F.col(c) for c in (id_col, vector_col, label_col))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    part = stage(
        rows.where(label.isNotNull() & vector.isNotNull()).where(~odd).select(
            F.monotonically_increasing_id().alias("row"), id_.cast("bigint").alias("vec_id"),
            label.cast("bigint").alias("label"), vector.cast("array<double>").alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ), "vectors",
    )
    anchors = stage(dense_index(part.where("is_anchor").drop("is_anchor"), "row", "anchor"), "anchors")
    size = part.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    count, width = anchors.count(), size.width
    step = max(1, GROUP_BYTES // (8 * max(width, 1)))
    others, found = part.select("row", "vec_id", "label", "vector"), []
    for start in range(0, count, step):
        group = anchors.where(F.col("anchor").between(start, start + step - 1))
        held = group.select("anchor", "row", "label", "vector").orderBy("anchor").toArrow()
        held = held.combine_chunks()
        given = {"place": held["anchor"].to_numpy(), "row": held["row"].to_numpy(),
                 "label": held["label"].to_numpy(),
                 "vectors": _matrix(held["vector"].combine_chunks(), width)}
        near = stage(_merged(others.mapInArrow(
            _scored(given, width, positives, None, ratio), _FOUND), positives), "positives")
        # a bounded group of anchors, a few rows each
        scores = near.select("anchor", "score").toPandas().drop_duplicates()
        scores = scores.sort_values(["anchor", "score"], ascending=[True, False])
        limits = np.full((held.num_rows, positives), _NONE)
        limits[scores["anchor"].to_numpy() - start, scores.groupby("anchor").cumcount().to_numpy()] = scores["score"]
        best = stage(_merged(others.mapInArrow(
            _scored(given, width, negatives, limits, ratio), _FOUND), negatives), "slots")
        found.append(_answers(group, near, best, negatives, ratio))
    if not found:
        kind = ", ".join(f"{c} {t}" for c, t in _ANSWER)
        return rows.sparkSession.createDataFrame([], kind)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_ANSWER = [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"),
           ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]


def _answers(group: DataFrame, near: DataFrame, best: DataFrame, k: int, ratio: tuple[int, int]) -> DataFrame:
    """Each positive's negatives: of the slots from its own downward, in falling order, the first
    rows that its lower limit lets in.  An anchor has ``k`` rows per slot at most."""
    slots = best.groupBy("anchor").agg(F.array_sort(F.collect_list(
        F.struct("slot", "rank", "vec_id", "score"))).alias("falling"))
    own = Window.partitionBy("anchor").orderBy(F.desc("score"))
    windows = near.select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        (F.dense_rank().over(own) - 1).alias("slot"))

    def let_in(n: Column) -> Column:
        return (n["slot"] >= F.col("slot")) & (
            ratio[1] * n["score"] >= ratio[0] * F.col("positive_score"))

    first = F.slice(F.filter("falling", let_in), 1, k)
    return (
        windows.join(slots, "anchor").join(group.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(first).alias("at", "n"))
        .select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"),
                F.col("n.vec_id").alias("negative_id"), "positive_score",
                F.col("n.score").alias("negative_score"))
    )
