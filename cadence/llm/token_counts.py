"""Exact histogram of document lengths in tokens, and what it answers for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.encoding import encoder, tokenizer_json
from cadence.runtime import stage

BLOCK = 4096
"""Lengths whose sums one window task adds up."""


def _lengths(spec: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec)
        for batch in batches:
            sizes = [len(encode(text.as_py())) // 4 for text in batch.column(0)]
            lengths, docs = np.unique(np.array(sizes, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths), pa.array(docs.astype(np.int64))], ["length", "docs"]
            )

    return count


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``length, docs``: how many documents have each number of ids.

    Documents are counted where they are encoded, so only counts are shuffled.  Null and empty
    texts have length 0; repeated rows count repeatedly; other columns are ignored; an empty
    table gives no rows.
    """
    counted = docs.select(text_col).mapInArrow(
        _lengths(tokenizer_json(tokenizer)), "length bigint, docs bigint"
    )
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def _running(hist: DataFrame, measures: list[str]) -> DataFrame:
    """Sums of ``measures`` over smaller lengths: over blocks of lengths, then within them."""
    blocks = hist.groupBy("block").agg(*[F.sum(m).alias(m) for m in measures])
    # a row per block: the longest document divided by BLOCK
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select(
        "block", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"base_{m}") for m in measures]
    )
    within = Window.partitionBy("block").orderBy("length").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return hist.join(base, "block").select(
        "length", "docs",
        *[(F.col(f"base_{m}") + F.sum(m).over(within)).alias(f"up_to_{m}") for m in measures],
    )


def context_totals(histogram: DataFrame) -> DataFrame:
    """One row per length that occurs, taken as a context limit.

    ``docs`` of that length, ``docs_longer``, ``tokens`` of documents up to the limit,
    ``truncated_tokens`` kept when all documents are cut there, ``lost_tokens`` cut off,
    ``share_fitting`` of documents that fit whole.  Between two lengths, truncated totals
    are linear in the limit; :func:`truncated_total` and :func:`quantiles` use that.
    """
    hist = stage(
        histogram.select(
            "length", "docs", (F.col("length") * F.col("docs")).alias("tokens"),
            F.floor(F.col("length") / BLOCK).alias("block"),
        ), "lengths",
    )
    totals = hist.agg(F.sum("docs").alias("all_docs"), F.sum("tokens").alias("all_tokens")).first()
    all_docs, all_tokens = totals["all_docs"] or 0, totals["all_tokens"] or 0
    summed = _running(hist, ["docs", "tokens"])
    longer = F.lit(all_docs) - F.col("up_to_docs")
    kept = F.col("up_to_tokens") + F.col("length") * longer
    return summed.select(
        F.col("length").alias("context_limit"), "docs", longer.alias("docs_longer"),
        F.col("up_to_tokens").alias("tokens"), kept.alias("truncated_tokens"),
        (F.lit(all_tokens) - kept).alias("lost_tokens"),
        (F.col("up_to_docs") / F.lit(all_docs)).alias("share_fitting"),
    )


def truncated_total(totals: DataFrame, limit: int) -> int:
    """Tokens kept when every document is cut at ``limit`` (any number from 0 on)."""
    below = totals.where(F.col("context_limit") <= limit).agg(
        F.max(F.struct("context_limit", "tokens", "docs_longer")).alias("r")
    ).first()["r"]
    if below is None:
        docs = totals.agg(F.sum("docs").alias("n")).first()["n"] or 0
        return docs * limit
    return below["tokens"] + below["docs_longer"] * limit


def quantiles(totals: DataFrame, shares: list[float]) -> list[int | None]:
    """For each share, the smallest length that at least that share of documents fits in."""
    row = totals.agg(*[
        F.min(F.when(F.col("share_fitting") >= s, F.col("context_limit"))).alias(f"q{k}")
        for k, s in enumerate(shares)
    ]).first()
    return list(row)
