"""Relations between sets of keyed rows: uniqueness, what is left, upserts, newest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.operators.ordering import columns


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows as ``n``."""
    return df.groupBy(*columns(keys)).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Return ``df``; raise naming some repeated keys if there are any."""
    repeated = duplicate_keys(df, *keys).limit(5).collect()
    if repeated:
        shown = ", ".join(str(tuple(r)[:-1]) for r in repeated)
        raise ValueError(f"Duplicate keys in {list(keys)}: {shown}")
    return df


def remaining_items(items: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Items whose key has no result yet."""
    names = _names(key)
    return items.join(done.select(*columns(names)), names, "left_anti")


def assert_complete(items: DataFrame, done: DataFrame, key: str | Sequence[str]) -> None:
    """Raise when some item has no result."""
    missing = remaining_items(items, done, key).select(*columns(_names(key))).limit(5).collect()
    if missing:
        raise ValueError(f"Items without a result, for example: {[tuple(r) for r in missing]}")


def upsert_results(base: DataFrame, delta: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``delta`` replaces ``base`` rows of the same key; each side has unique keys."""
    return delta.unionByName(remaining_items(base, delta, key))


def latest_by_key(df: DataFrame, keys: str | Sequence[str],
                  order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key in ``order``, for data where later rows replace earlier."""
    return keep_latest(df, keys, order, 1)


def keep_latest(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str | Column],
                n: int = 3) -> DataFrame:
    """The ``n`` last rows of each key.

    Spark plans this as a group limit before and after the shuffle, so a hot key sends
    at most ``n`` rows per input partition, up to a limit on ``n`` of its own; a larger ``n``
    sorts the key's rows in one task, spilling if need be.
    """
    order = [order] if isinstance(order, (str, Column)) else order
    newest = [c.desc() for c in columns(order)]
    window = Window.partitionBy(*columns(_names(keys))).orderBy(*newest)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def ordered_results(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Results in key order."""
    return df.orderBy(*columns(_names(key)))
