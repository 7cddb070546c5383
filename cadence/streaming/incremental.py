"""Jobs that take only what is new in a source, and how often they commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cadence.functions.steps import step_spec
from cadence.runtime import remove
from cadence.sources.manifests import Entry, claim, commit, merge, read_manifest
from cadence.sources.states import committed_numbers

MERGE_BATCHES = 100  # batches of a folder that are rewritten as one


def store_batch(rows: DataFrame, number: int, out: str, checkpoint: str,
                merge_batches: int | None) -> None:
    """Write a micro-batch's rows to its own folder under ``out`` and add it to the manifest."""
    spark = rows.sparkSession
    manifest = read_manifest(spark, out)
    known = manifest and manifest.covers(number)
    if known and known.first < known.last:
        return  # merged since, so its delivery was complete
    rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
    commit(spark, out, checkpoint, Entry(number, number, f"batch={number}"))
    if merge_batches is not None:
        merge(spark, out, merge_batches)


def incremental_job(stream: DataFrame, fn: Callable[[DataFrame], DataFrame], checkpoint: str,
                    out: str, trigger: dict | None = None,
                    merge_batches: int | None = MERGE_BATCHES) -> StreamingQuery:
    """Start a job that runs ``fn`` over new input and stores it under ``out``.

    Source offsets in ``checkpoint`` say where to go on, so a rerun without new input
    does nothing.  A micro-batch may be delivered twice; it overwrites its own folder.
    ``out`` belongs to the checkpoint: with another, whose batches have other rows under the
    same numbers, the job refuses to start.  A manifest lists the committed batches, and once
    there are ``merge_batches`` of them, all but the newest are rewritten as one folder.
    Read the result with ``read_batches``.
    """
    claim(stream.sparkSession, out, checkpoint, "batch")

    def store(batch: DataFrame, number: int) -> None:
        store_batch(fn(batch), number, out, checkpoint, merge_batches)

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


class PendingBatches:
    """``foreachBatch`` function that collects micro-batches and hands them on together.

    Every micro-batch is written under ``pending``.  At numbers that the step spec selects,
    ``action(rows, number)`` gets all rows since the last time; ``flush`` at the end of a run
    hands on the rest, so nothing is lost whatever the spec.  A micro-batch that is delivered
    again brings the same rows to the same number: what was handed on stays until the next
    time.  ``action`` should overwrite what it stored under the same number.
    """

    def __init__(self, spec: str, action: Callable[[DataFrame, int], None], pending: str):
        self.spec, self.action, self.pending = step_spec(spec), action, pending

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.pending}/batch={number}")
        if self.spec.fires_at(number):
            self._hand_on(batch.sparkSession, number)

    def flush(self, spark: SparkSession) -> None:
        """Hand on what is still pending; call it when the run has ended."""
        numbers = committed_numbers(spark, self.pending, "batch")
        done = committed_numbers(spark, self.pending, "handed")
        if numbers and max(numbers) > max(done, default=-1):
            self._hand_on(spark, max(numbers))

    def _hand_on(self, spark: SparkSession, number: int) -> None:
        handed = committed_numbers(spark, self.pending, "handed")
        last = max((n for n in handed if n < number), default=-1)
        stored = committed_numbers(spark, self.pending, "batch")
        paths = [f"{self.pending}/batch={n}" for n in stored if last < n <= number]
        self.action(spark.read.parquet(*paths), number)
        spark.range(0).write.mode("overwrite").parquet(f"{self.pending}/handed={number}")
        for n in stored:
            if n <= last:
                remove(spark, f"{self.pending}/batch={n}")


def on_batches(spec: str, action: Callable[[DataFrame, int], None], pending: str) -> PendingBatches:
    """Let ``action`` have what has piled up at batch numbers the step spec selects."""
    return PendingBatches(spec, action, pending)


def cadence(seconds: float | None = None, files: int | None = None,
            rows: int | None = None) -> dict[str, dict]:
    """When to commit: ``trigger`` arguments, source ``options``, ``resume`` arguments.

    Time sets the trigger of a stream and the pace of ``resumable_map``, files limit the
    micro-batches of a stream, and rows the batches of ``resumable_map``.
    """
    trigger: dict = {"availableNow": True}
    resume: dict = {}
    if seconds is not None:
        trigger = {"processingTime": f"{round(seconds * 1000)} milliseconds"}
        resume["commit_seconds"] = seconds
    if rows is not None:
        resume["batch_rows"] = rows
    options = {} if files is None else {"maxFilesPerTrigger": str(files)}
    return {"trigger": trigger, "options": options, "resume": resume}
