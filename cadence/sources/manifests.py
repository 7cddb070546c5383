"""What jobs have committed under a folder, in one small list per folder.

A manifest names the job that owns the folder, and the folders of its numbers in order.  Every
commit writes the whole list again under the next version; the newest version counts.  Small
folders are merged into larger ones from time to time, so the list stays short and reading it
takes two file-system calls, however many numbers it covers.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cadence.runtime import children, read_text, remove, subfolders, write_text

MANIFEST = "_manifest"
VERSIONS_KEPT = 3
_VERSION = re.compile(r"(\d+)\.json")


@dataclass(frozen=True)
class Entry:
    """The numbers ``first`` to ``last``, stored in one folder."""

    first: int
    last: int
    folder: str


@dataclass(frozen=True)
class Manifest:
    owner: str | None = None
    version: int = -1
    entries: tuple[Entry, ...] = ()
    retired: tuple[str, ...] = field(default=())  # merged into others; dropped at the next merge

    @property
    def last(self) -> int:
        return max((e.last for e in self.entries), default=-1)

    def covers(self, number: int) -> Entry | None:
        return next((e for e in self.entries if e.first <= number <= e.last), None)


def read_manifest(spark: SparkSession, root: str) -> Manifest | None:
    """The newest manifest of a folder, None without one."""
    found = (_VERSION.fullmatch(name) for name in children(spark, f"{root}/{MANIFEST}"))
    versions = sorted((int(m[1]) for m in found if m), reverse=True)
    if not versions:
        return None
    held = json.loads(read_text(spark, f"{root}/{MANIFEST}/{versions[0]:09d}.json"))
    entries = tuple(Entry(**e) for e in held["entries"])
    return Manifest(held["owner"], versions[0], entries, tuple(held["retired"]))


def write_manifest(spark: SparkSession, root: str, manifest: Manifest) -> Manifest:
    """Store ``manifest`` as the next version, and drop versions that are no longer needed."""
    written = replace(manifest, version=manifest.version + 1)
    text = json.dumps(asdict(written))
    write_text(spark, f"{root}/{MANIFEST}/{written.version:09d}.json", text)
    outdated = written.version - VERSIONS_KEPT
    if outdated >= 0:
        remove(spark, f"{root}/{MANIFEST}/{outdated:09d}.json")
    return written


def job_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The lasting id of the query that owns a checkpoint folder; None before its first run."""
    if "metadata" not in children(spark, checkpoint):
        return None
    return json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]


def claim(spark: SparkSession, root: str, checkpoint: str, label: str) -> None:
    """Refuse a folder that belongs to another checkpoint, whose numbers mean other rows.

    A folder with numbered subfolders but no manifest is refused as well: nobody knows whose.
    """
    manifest, own = read_manifest(spark, root), job_id(spark, checkpoint)
    if manifest is not None:
        if manifest.owner != own:
            raise ValueError(
                f"{root} holds the output of another run (id {manifest.owner}), while the checkpoint "
                f"{checkpoint} has {f'id {own}' if own else 'not been used yet'}. Use a folder of its own."
            )
    elif any(name.startswith(f"{label}=") for name in subfolders(spark, root)):
        raise ValueError(f"{root} holds {label} folders without a manifest; use an empty folder.")


def commit(spark: SparkSession, root: str, checkpoint: str, entry: Entry) -> Manifest:
    """Add an entry; one that is there already, as after a repeated delivery, changes nothing."""
    manifest = read_manifest(spark, root) or Manifest(job_id(spark, checkpoint))
    if entry in manifest.entries:
        return manifest
    return write_manifest(spark, root, replace(manifest, entries=(*manifest.entries, entry)))


def merge(spark: SparkSession, root: str, least: int, keep: int = 1) -> Manifest | None:
    """Rewrite all entries of one number but the newest ``keep`` as one folder, once there are
    ``least``.  The merged folders are dropped at the merge after, so that readers can finish."""
    manifest = read_manifest(spark, root)
    if manifest is None:
        return None
    single = [e for e in manifest.entries if e.first == e.last][:-keep or None]
    if len(single) < max(2, least):
        return manifest
    first, last = single[0].first, single[-1].last
    merged = Entry(first, last, f"merged={first}-{last}")
    spark.read.parquet(*(f"{root}/{e.folder}" for e in single)).write.mode("overwrite").parquet(
        f"{root}/{merged.folder}")
    left = sorted({*manifest.entries, merged} - set(single), key=lambda e: e.first)
    written = write_manifest(spark, root, replace(
        manifest, entries=tuple(left), retired=tuple(e.folder for e in single)))
    for folder in manifest.retired:
        remove(spark, f"{root}/{folder}")
    return written


def read_entries(spark: SparkSession, root: str, manifest: Manifest,
                 schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*(f"{root}/{e.folder}" for e in manifest.entries))
