"""Versioned whole-state tables: commit, list, read the newest, drop old ones.

A version is a folder ``version=<n>``, under ``total=<N>`` when the state belongs to a
run over N items.  It counts once ``_SUCCESS``, which Spark writes last, is there.
These are states that hold everything; output that is appended batch by batch is the
only copy of its rows and is never pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.runtime import is_committed, remove, subfolders

STATES = "version bigint, total bigint, complete boolean"


def version_path(root: str, version: int, total: int | None = None) -> str:
    parent = root if total is None else f"{root}/total={total}"
    return f"{parent}/version={version}"


def _numbered(names: list[str], label: str) -> list[int]:
    texts = (n.removeprefix(f"{label}=") for n in names if n.startswith(f"{label}="))
    return sorted(int(t) for t in texts if t.isdigit())


def committed_numbers(spark: SparkSession, root: str, label: str) -> list[int]:
    """Numbers n whose folder ``label=n`` under ``root`` holds a finished write."""
    found = _numbered(subfolders(spark, root), label)
    return [n for n in found if is_committed(spark, f"{root}/{label}={n}")]


def _states(spark: SparkSession, root: str) -> list[tuple[int, int | None, bool]]:
    names = subfolders(spark, root)
    totals = _numbered(names, "total")
    plain = _numbered(names, "version")
    if len(totals) + bool(plain) > 1:
        raise ValueError(
            f"States of different totals under {root}: {totals or ''}{' and none' if plain else ''}. "
            "Use one folder per run."
        )
    total = totals[0] if totals else None
    versions = _numbered(subfolders(spark, f"{root}/total={total}"), "version") if totals else plain
    return [(v, total, is_committed(spark, version_path(root, v, total))) for v in versions]


def list_states(spark: SparkSession, root: str) -> DataFrame:
    """Manifest (version, total, complete); states of two totals are an error."""
    return spark.createDataFrame(_states(spark, root), STATES)


def latest_index(states: DataFrame) -> DataFrame:
    """Highest complete version as ``latest``, -1 when there is none."""
    newest = F.max(F.when(F.col("complete"), F.col("version")))
    return states.agg(F.coalesce(newest, F.lit(-1).cast("bigint")).alias("latest"))


def read_latest_state(spark: SparkSession, root: str | None) -> tuple[int, DataFrame | None]:
    """(version, table) of the newest complete state; (-1, None) when there is none."""
    complete = [s for s in _states(spark, root) if s[2]] if root is not None else []
    if not complete:
        return -1, None
    version, total, _ = complete[-1]
    return version, spark.read.parquet(version_path(root, version, total))


def commit_state(df: DataFrame, root: str | None, version: int, total: int | None = None) -> None:
    """Write a state; without a root nothing is stored."""
    if root is not None:
        df.write.mode("overwrite").parquet(version_path(root, version, total))


def prune_states(spark: SparkSession, root: str | None, keep: int = 3) -> int:
    """Drop all but the ``keep`` newest complete states; gives how many went."""
    if root is None:
        return 0
    if keep < 1:
        raise ValueError("keep at least one state")
    complete = [s for s in _states(spark, root) if s[2]]
    for version, total, _ in complete[:-keep]:
        path = version_path(root, version, total)
        # the marker goes first, so that a half-deleted state no longer counts
        remove(spark, f"{path}/_SUCCESS")
        remove(spark, path)
    return len(complete[:-keep])
