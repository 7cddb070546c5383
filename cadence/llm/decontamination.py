"""Benchmark decontamination: windows of test words found in training documents."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.runtime import quoted, stage

WINDOW = 10
BROADCAST_BYTES = 64 << 20
"""Largest set of distinct windows, in bytes of their words, that is sent to every worker."""
FOUND = (
    "struct<n_words:bigint,n_hit:bigint,items:array<bigint>,"
    "spans:array<struct<start:int,stop:int>>>"
)

# words: runs of a-z, digits and characters beyond ASCII, after A-Z are lower-cased
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b in _SEPARATORS else b for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def item_windows(words: list[bytes], size: int) -> set[bytes]:
    """All runs of ``size`` words; all words, if they are fewer but not none."""
    if not words:
        return set()
    last = max(1, len(words) - size + 1)
    return {b" ".join(words[k:k + size]) for k in range(last)}


def _hits_to_spans(hits: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge runs of words [start, stop) that overlap or touch."""
    spans: list[tuple[int, int]] = []
    for start, stop in sorted(hits):
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
        else:
            spans.append((start, stop))
    return spans


def _code_points(text: bytes, spans: list[tuple[int, int]]) -> list[dict]:
    """Runs of words to where they stand in the text, in code points."""
    if not spans:
        return []
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_TABLE_KEEP))]
    # a code point begins at every byte that does not continue one
    begins = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])
    return [
        {"start": int(before[places[a][0]]), "stop": int(before[places[b - 1][1]])} for a, b in spans
    ]


_TABLE_KEEP = bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in _TABLE)


def _found(text: bytes, n_words: int, hits: list[tuple[int, int]], items: set) -> dict:
    spans = _hits_to_spans(hits)
    return {
        "n_words": n_words, "n_hit": sum(b - a for a, b in spans),
        "items": sorted(items), "spans": _code_points(text, spans),
    }


class WindowSet:
    """Windows of all items, hashed; a hash that matches is verified by its words."""

    def __init__(self, items: dict[bytes, list]):
        self.items = items
        split = {window: window.split(b" ") for window in items}
        vocabulary = sorted({w for words in split.values() for w in words})
        self.ids = {word: n for n, word in enumerate(vocabulary, 1)}
        rng = np.random.default_rng(7)
        self.codes = rng.integers(1, 1 << 63, len(vocabulary) + 1).astype(np.uint64)
        by_size = defaultdict(list)
        for words in split.values():
            by_size[len(words)].append([self.ids[w] for w in words])
        self.hashes = {
            size: np.unique(self._sums(np.array(rows, np.int64).T)) for size, rows in by_size.items()
        }

    def _sums(self, columns) -> np.ndarray:
        total = np.uint64(0)
        for column in columns:
            total = total * np.uint64(0x9E3779B97F4A7C15) + self.codes[column]
        return total

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Where windows occur, as (first word, words), among the words of many documents.

        A document's end is marked by an empty word, which no window has.
        """
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        found = []
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            sums = self._sums(ids[at + k] for k in range(size))
            place = np.searchsorted(hashes, sums)
            place[place == len(hashes)] = 0
            for start in at[hashes[place] == sums].tolist():
                if b" ".join(words[start:start + size]) in self.items:
                    found.append((start, size))
        return found

    def scan(self, texts: list[bytes | None]) -> list[dict]:
        """For each text: its words, words hit, items met, and the spans hit."""
        all_words: list[bytes] = []
        starts, counts = [], []
        for text in texts:
            words = words_of(text)
            starts.append(len(all_words))
            counts.append(len(words))
            all_words += words
            all_words.append(b"")
        hits: dict[int, list] = defaultdict(list)
        items: dict[int, set] = defaultdict(set)
        for start, size in self.find(all_words):
            doc = int(np.searchsorted(starts, start, side="right")) - 1
            hits[doc].append((start - starts[doc], start - starts[doc] + size))
            items[doc].update(self.items[b" ".join(all_words[start:start + size])])
        return [
            _found(text or b"", counts[k], hits.get(k, []), items.get(k, set()))
            for k, text in enumerate(texts)
        ]


def _benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """``window, items``: each distinct window and the distinct ids of its items."""

    @F.arrow_udf("array<binary>")
    def windows(texts: pa.Array) -> pa.Array:
        return pa.array(
            [sorted(item_windows(words_of(t.as_py()), size)) for t in texts], pa.list_(pa.binary())
        )

    cut = benchmark.select(
        F.col(item_col).cast("bigint").alias("item"),
        F.explode(windows(F.col(text_col).cast("binary"))).alias("window"),
    )
    return cut.groupBy("window").agg(F.collect_set("item").alias("items"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, out_col: str = "found",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``n_words, n_hit, items, spans`` in ``out_col``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one.  Words
    inside any occurrence of a window are hit; ``items`` are the ids of items with a window that
    occurs, ``spans`` the hit passages in code points.  A null text has no words; an item
    without an id still hits but is not listed; items and documents may repeat; a column that
    is called ``out_col`` already is replaced.  Empty tables on either side are fine.

    The windows' size is measured; up to ``broadcast_bytes`` they go to every worker as a hash
    set, and documents are scanned where they are, without a shuffle.  Beyond, windows of
    documents and items are joined.  Both give the same rows and columns, ``out_col`` last.
    """
    spark = docs.sparkSession
    windows = stage(
        _benchmark_windows(benchmark, item_col, item_text_col, window), "windows"
    )
    size = windows.agg(
        F.sum(F.octet_length("window") + 8 * F.size("items")).alias("n")
    ).first()["n"] or 0
    if size > broadcast_bytes:
        return _joined(docs, windows, text_col, out_col)
    # plain values, which a worker unpacks once and keeps for its later tasks
    sent = spark.sparkContext.broadcast(
        vars(WindowSet({bytes(r["window"]): r["items"] for r in windows.collect()})))

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WindowSet.__new__(WindowSet)
        known.__dict__ = sent.value
        for texts in batches:
            out: list[dict] = []
            for at in range(0, len(texts), 200):
                out += known.scan(texts.slice(at, 200).to_pylist())
            yield pa.array(out, _ARROW)

    return docs.select(
        *(F.col(quoted(c)) for c in docs.columns if c != out_col),
        scan(F.col(quoted(text_col)).cast("binary")).alias(out_col))


_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
])


def _joined(docs: DataFrame, windows: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """The same by a join of all windows; for sets of items that no worker should hold."""
    sizes = sorted(r[0] for r in windows.select(
        F.size(F.split(F.col("window").cast("string"), " "))).distinct().collect())

    @F.arrow_udf("array<struct<start:int,n:int,window:binary>>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts:
            words = words_of(text.as_py())
            out.append([
                {"start": k, "n": n, "window": b" ".join(words[k:k + n])}
                for n in sizes for k in range(len(words) - n + 1)
            ])
        kind = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("window", pa.binary())])
        return pa.array(out, pa.list_(kind))

    @F.arrow_udf(FOUND)
    def gather(texts: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts, hits):
            text, own = text.as_py() or b"", own.as_py() or []
            spans = [(h["start"], h["start"] + h["n"]) for h in own]
            items = {item for h in own for item in h["items"]}
            out.append(_found(text, len(words_of(text)), spans, items))
        return pa.array(out, _ARROW)

    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("doc")), "rows")
    data = F.col(f"doc.{quoted(text_col)}").cast("binary")
    found = (
        rows.select("row", F.explode(cut(data)).alias("w")).select("row", "w.*")
        .join(windows, "window").groupBy("row")
        .agg(F.collect_list(F.struct("start", "n", "items")).alias("hits"))
    )
    return rows.join(found, "row", "left").select("doc", gather(data, F.col("hits")).alias("found")).select(
        *(F.col(f"doc.{quoted(c)}").alias(c) for c in docs.columns if c != out_col),
        F.col("found").alias(out_col))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the spans that :func:`contamination` found."""
    ends = F.transform(spans, lambda s: s["stop"])
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    kept = F.zip_with(
        F.concat(F.array(F.lit(0)), ends), starts,
        lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0))),
    )
    return F.when(text.isNotNull(), F.array_join(kept, ""))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_col: str = "text",
    **options,
) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) without the hit spans."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    name = "found"
    while name in docs.columns:
        name += "_"
    found = contamination(docs, benchmark, text_col, out_col=name, **options)
    if remove == "documents":
        return found.where(F.col(f"{name}.n_hit") == 0).drop(name)
    cleaned = without_spans(F.col(text_col), F.col(f"{name}.spans"))
    return found.withColumn(text_col, cleaned).drop(name)
