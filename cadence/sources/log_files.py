"""Log lines to records and back, in four fixed layouts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadence.functions.levels import level_to_int
from cadence.runtime import stage

# The fields of each layout, in line order, before ": message".
LAYOUTS = {
    "extended": ("ts", "logger", "func", "level"),
    "short": ("ts", "logger", "level"),
    "shorter": ("ts", "level"),
    "shortest": ("ts",),
}
_FIELD = {
    "ts": r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})",
    "logger": r"(\S+)",
    "func": r"(\S+)",
    "level": r"(Level -?\d+|[^\s:]+)",
}
_MARK = "\x01"


def _pattern(layout: str) -> str:
    return "^" + " ".join(_FIELD[f] for f in LAYOUTS[layout]) + ": (.*)$"


def _parsed(text: Column, layout: str) -> list[Column]:
    """Columns ts, logger, func, level, level_no, message of a line."""
    fields, pattern = LAYOUTS[layout], _pattern(layout)
    matched = text.rlike(pattern)
    # one run of the pattern per line: rewrite the groups with a mark, split at it
    marked = F.regexp_replace(text, pattern, _MARK.join(f"${i + 1}" for i in range(len(fields) + 1)))
    parts = F.when(matched, F.split(marked, _MARK, len(fields) + 1))

    def part(field: str) -> Column:
        if field not in fields:
            return F.lit(None).cast("string")
        return parts[fields.index(field)]

    level = part("level")
    number = F.coalesce(
        level_to_int(level, strict=False),
        F.regexp_extract(level, r"^Level (-?\d+)$", 1).try_cast("int"),
    )
    return [
        part("ts").try_cast("timestamp_ntz").alias("ts"),
        part("logger").alias("logger"),
        part("func").alias("func"),
        level.alias("level"),
        number.alias("level_no"),
        F.when(matched, parts[len(fields)]).otherwise(text).alias("message"),
    ]


def parse_log_lines(lines: DataFrame, layout: str, line: str = "value") -> DataFrame:
    """Records (ts, logger, func, level, level_no, message) of a text column.

    A line that does not fit the layout continues the record before it, as tracebacks
    do: it is kept as a record with its text as message and NULL elsewhere.  Works on
    a streaming frame as well.
    """
    return lines.select(*_parsed(F.col(line), layout))


def scan_log_lines(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path), layout)


_PIECE = "file string, split bigint, local bigint, line string, more string"


def _joined(lines: pa.Array, counts: np.ndarray) -> pa.Array:
    """Runs of so many lines each to one text; NULL for no lines."""
    offsets = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
    texts = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")
    return pc.if_else(pa.array(counts > 0), texts, pa.scalar(None, pa.string()))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, split, head, value) in their order to pieces of a split of a file: a record's
    first line and the lines that continue it; piece 0 is what a split begins with before its
    first record."""
    place, begun = (None, None), 0  # the split that goes on, and the records begun in it
    held: list[pa.Table] = []  # the last piece, which may go on

    def made(lines: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        nonlocal place, begun
        lines = lines.combine_chunks()
        file, split, head, text = (lines.column(k).chunk(0) for k in range(4))
        heads = head.to_numpy(zero_copy_only=False)
        first = heads[starts]
        names, splits = file.take(pa.array(starts)), split.to_numpy()[starts]
        name_ids = names.dictionary_encode().indices.to_numpy()
        fresh = np.append(True, (name_ids[1:] != name_ids[:-1]) | (splits[1:] != splits[:-1]))
        fresh[0] = (names[0].as_py(), int(splits[0])) != place
        total = np.cumsum(first) + begun
        at = np.flatnonzero(fresh)
        base = np.zeros(len(starts), np.int64)
        base[at] = np.diff(np.append(0, (total - first)[at]))
        local = total - np.cumsum(base)
        place, begun = (names[-1].as_py(), int(splits[-1])), int(local[-1])
        lengths = np.diff(np.append(starts, len(heads))) - first
        more = _joined(text.filter(pa.array(~heads)), lengths)
        line = pc.if_else(pa.array(first), text.take(pa.array(starts)), pa.scalar(None, pa.string()))
        return pa.RecordBatch.from_arrays(
            [names, pa.array(splits), pa.array(local), line, more], ["file", "split", "local", "line", "more"])

    last = (None, None)
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        file, split = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        ids = file.indices.to_numpy()
        cut = batch.column(2).to_numpy(zero_copy_only=False).copy()
        cut[1:] |= (ids[1:] != ids[:-1]) | (split[1:] != split[:-1])
        cut[0] |= (batch.column(0)[0].as_py(), int(split[0])) != last
        last = (batch.column(0)[-1].as_py(), int(split[-1]))
        starts = np.flatnonzero(cut)
        if len(starts):
            if held:
                held.append(table.slice(0, int(starts[0])))
                yield made(pa.concat_tables(held), np.array([0]))
            if len(starts) > 1:
                whole = table.slice(int(starts[0]), int(starts[-1] - starts[0]))
                yield made(whole, starts[:-1] - starts[0])
            held = []
            table = table.slice(int(starts[-1]))
        held.append(table)
    if held:
        yield made(pa.concat_tables(held), np.array([0]))


def scan_log_records(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    """Whole records (file, record, ts, logger, func, level, level_no, message, traceback).

    ``record`` counts from 0 in each file, in the order of its lines.  Lines that do not fit the
    layout continue the record before them, across the splits in which a large file is read; they
    are its ``traceback``, joined by line ends, blank ones included, or NULL if there are none.
    What stands before a file's first record comes as record -1 with a traceback only.

    Lines are put together where they are read.  Only what a split begins with goes to the record
    it continues, in a join; a record's number is its place in its split and the records in the
    file's splits before, one sum per split.
    """
    lines = spark.read.options(**options).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").rlike(_pattern(layout)).alias("head"), "value",
    )
    pieces = stage(lines.mapInArrow(_pieces, _PIECE), "log-pieces")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        pieces.groupBy("file", "split").agg(F.max("local").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    )
    parts = F.transform(F.array_sort(F.collect_list(F.struct("split", "more"))), lambda p: p["more"])
    carried = (
        pieces.where("local = 0").join(before, ["file", "split"])
        .groupBy("file", (F.col("before") - 1).alias("record"))
        .agg(F.array_join(parts, "\n").alias("carried"))  # as many parts as splits a record spans
    )
    records = (
        pieces.where("local > 0").join(before, ["file", "split"])
        .select("file", (F.col("before") + F.col("local") - 1).alias("record"), "line", "more")
        .join(carried, ["file", "record"], "left")
        .unionByName(carried.where("record = -1").select(
            "file", "record", "carried", *(F.lit(None).cast("string").alias(c) for c in ("line", "more"))))
    )
    traceback = F.when(F.col("more").isNotNull() | F.col("carried").isNotNull(),
                       F.concat_ws("\n", "more", "carried"))
    return records.select("file", "record", *_parsed(F.col("line"), layout), traceback.alias("traceback"))


def stream_log_lines(spark: SparkSession, path: str, layout: str, **options) -> DataFrame:
    return parse_log_lines(spark.readStream.options(**options).text(path), layout)


def log_line(layout: str) -> Column:
    """Text line of a record with columns ts, logger, func, level and message.

    A record without a time continues the one before it, so its message is the line.
    """
    def shown(field: str) -> Column:
        text = F.col(field).cast("string")
        # to the second; the text of a timestamp needs no time zone, unlike date_format
        return F.substring(text, 1, 19) if field == "ts" else F.coalesce(text, F.lit("None"))

    line = F.concat(F.concat_ws(" ", *map(shown, LAYOUTS[layout])), F.lit(": "), shown("message"))
    return F.when(F.col("ts").isNull(), F.col("message")).otherwise(line).alias("value")


def sink_log_lines(records: DataFrame, path: str, layout: str = "extended",
                   mode: str = "errorifexists") -> None:
    """Write records as text lines."""
    records.select(log_line(layout)).write.mode(mode).text(path)
