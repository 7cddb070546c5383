"""Lines that recur in many documents, by sharded minimal perfect hashes.

Hashes of recurring lines are dealt into shards of bounded size.  A shard is one compact index: a
minimal perfect hash gives each of its hashes a slot of three arrays, the fingerprint by which
other lines are told apart, the number of documents, and the greatest document.  Documents send
the hashes of their lines, not the lines, past the arrays of a shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.runtime import quoted, stage

SHARD_KEYS = 1 << 18
"""Hashes per shard, on average; an index takes some 20 bytes for each."""
PROBES = 1 << 20
"""Probes of recurring lines that one copy of a shard answers; a shard with more is copied."""
GAMMA = 2.0
"""Bits per hash in a level of the perfect hash."""
LEAST_ID = -(1 << 63)  # where rows without an id stand

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def line_key(line: bytes) -> bytes:
    """A line without white space (blank, tab to carriage return) at its ends, A-Z lowered."""
    return line.strip().translate(_LOWER)


def long_enough(key: bytes, least_chars: int) -> bool:
    """Whether a key has so many code points, of one to four bytes each."""
    if not least_chars <= len(key) < 4 * least_chars:
        return len(key) >= least_chars
    return len(key.decode("utf-8", "replace")) >= least_chars


def _mixed(first: np.ndarray, second: np.ndarray, level: int) -> np.ndarray:
    """An independent hash of a hash's two words for each level."""
    x = first ^ (second * np.uint64(2 * level + 3) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct pairs of 64-bit words to the numbers 0 to n - 1.

    In each level a pair sets the bit its hash points at, if no other pair left points there; the
    others go on to the next level.  A pair's number is the count of set bits before its own.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits  # bits of all levels, 64 to a word
        counts = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(first):
            size = -(-max(64, int(GAMMA * len(first))) // 64) * 64
            at = (_mixed(first, second, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            first, second = first[~alone], second[~alone]
        return cls(sizes, np.concatenate([np.empty(0, "<u8"), *words]))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each pair; any number, or -1, for pairs that are not in the hash."""
        out, left, base = np.full(len(first), -1, np.int64), np.arange(len(first)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mixed(first[left], second[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            rest = word[found] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[left[found]] = self.before[at[found] >> 6] + np.bitwise_count(rest)
            left, base = left[~found], base + size
        return out


class LineIndex:
    """The arrays of one shard: fingerprints, counts and greatest documents by slot."""

    def __init__(self, hashes: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray):
        self.hashes, self.prints, self.counts, self.last = hashes, prints, counts, last

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        hashes = PerfectHash.build(first, second)
        order = np.argsort(hashes.slots(first, second))
        return cls(hashes, second[order], counts[order], last[order])

    def dump(self) -> bytes:
        head = struct.pack(f"<qq{len(self.hashes.sizes)}q", len(self.prints), len(self.hashes.sizes),
                           *self.hashes.sizes)
        arrays = (self.hashes.bits, self.prints, self.counts.astype("<u4"), self.last)
        return head + b"".join(a.astype(a.dtype.newbyteorder("<")).tobytes() for a in arrays)

    @classmethod
    def load(cls, data: bytes) -> LineIndex:
        keys, levels = struct.unpack_from("<qq", data)
        sizes = list(struct.unpack_from(f"<{levels}q", data, 16))
        at, arrays = 16 + 8 * levels, []
        for kind, n in (("<u8", sum(sizes) // 64), ("<u8", keys), ("<u4", keys), ("<i8", keys)):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        return cls(PerfectHash(sizes, arrays[0]), *arrays[1:])

    def probe(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of documents of each hash, 0 for others, and the greatest document."""
        slots = self.hashes.slots(first, second)
        known = slots >= 0
        known[known] = self.prints[slots[known]] == second[known]
        counts, last = np.zeros(len(first), np.int64), np.full(len(first), LEAST_ID)
        counts[known], last[known] = self.counts[slots[known]], self.last[slots[known]]
        return counts, last


def _hashed_lines(least_chars: int):
    """Batches of (row, place, text) to a row per distinct key of each text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            found, owner = [], []
            for k, text in enumerate(batch.column(2)):
                keys = {line_key(line) for line in (text.as_py() or b"").split(b"\n")}
                prints = [digest(key) for key in keys if long_enough(key, least_chars)]
                found += prints
                owner.append(len(prints))
            words = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            of = pa.array(np.repeat(np.arange(len(owner)), owner))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of),
                 pa.array(words[:, 0]), pa.array(words[:, 1])], ["row", "place", "h1", "h2"])

    return hashed


def _indexes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (shard, h1, h2, n, last) in order of the shard to an index per shard."""

    def built(parts: list[np.ndarray]) -> pa.RecordBatch:
        shard, first, second, counts, last = (np.concatenate(p) for p in zip(*parts))
        index = LineIndex.build(first.view(np.uint64), second.view(np.uint64), counts, last)
        return pa.RecordBatch.from_arrays(
            [pa.array(shard[:1]), pa.array([int(counts.sum())], pa.int64()),
             pa.array([index.dump()], pa.binary())], ["shard", "probes", "arrays"])

    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        edges = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if held and held[-1][0][0] != columns[0][a]:
                yield built(held)
                held = []
            held.append([c[a:b] for c in columns])
    if held:
        yield built(held)


def _probed(least_documents: int):
    """Batches of (shard, copy, arrays, row, place, h1, h2), the arrays of a shard before its
    probes, to the rows and hashes whose line the row loses."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, of = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            copies = batch.column(1).to_numpy()
            arrays = batch.column(2)
            heads = np.flatnonzero(arrays.is_valid().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(copies) != 0)) + 1
            edges = np.unique(np.concatenate([[0], heads, cuts, [batch.num_rows]])).tolist()
            for a, b in zip(edges, edges[1:]):
                if arrays[a].is_valid:
                    index, of = LineIndex.load(arrays[a].as_py()), (shards[a], copies[a])
                    a += 1
                if a >= b or of != (shards[a], copies[a]):
                    continue  # a shard without recurring lines has no arrays
                row, place, first, second = (
                    batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                    for k in range(3, 7))
                counts, last = index.probe(first.view(np.uint64), second.view(np.uint64))
                lost = (counts >= least_documents) & (place < last)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[lost]) for c in (row, first, second)], ["row", "h1", "h2"])

    return probed


_KEPT = "struct<text:string,n_lines:bigint,n_dropped:bigint>"


def _without(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
    """Texts without the lines of the given hashes."""
    kept, lines, dropped = [], [], []
    for text, first, second in zip(texts, firsts, seconds):
        every = (text.as_py() or b"").split(b"\n")
        left = every
        if first.is_valid:
            pairs = np.stack([first.values.to_numpy(), second.values.to_numpy()], axis=1)
            lost = {p.tobytes() for p in pairs.astype("<i8")}
            left = [line for line in every if xxhash.xxh3_128_digest(line_key(line)) not in lost]
        kept.append(b"\n".join(left).decode("utf-8", "replace") if text.is_valid else None)
        lines.append(len(every))
        dropped.append(len(every) - len(left))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
        ["text", "n_lines", "n_dropped"])


def recurring_lines(lines: DataFrame, least_documents: int) -> tuple[DataFrame, int]:
    """The indexes ``shard, probes, arrays`` of the hashes that so many rows hold, and the number
    of shards; ``lines`` has ``h1, h2, place`` once per row and hash."""
    counted = stage(
        lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("place").alias("last"))
        .where(F.col("n") >= least_documents),
        "recurring",
    )
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    dealt = counted.select(_shard(shards), "h1", "h2", "n", "last")
    indexed = dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        _indexes, "shard bigint, probes bigint, arrays binary")
    return stage(indexed, "line-index"), shards


def _shard(shards: int):
    return F.pmod("h1", F.lit(shards)).alias("shard")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20,
    least_documents: int = 3, out_col: str = "lines",
) -> DataFrame:
    """``docs`` without lines that recur: those whose key (see :func:`line_key`) has at least
    ``least_chars`` code points and is found in at least ``least_documents`` rows stay only in the
    rows of the greatest id that holds them.  ``out_col`` is ``struct<n_lines, n_dropped>``.

    Lines end at ``\\n``; what stays is joined by it.  Keys are told apart by 128-bit hashes.  The
    ids are integers; a row without one stands before all others, and if no row that holds a line
    has an id, all keep it.  Rows that repeat an id count as documents of their own, and stay or
    lose a line together.  A null text has one empty line and stays null.  An empty table gives
    none.  A column named ``out_col`` is replaced; all other columns stay, whatever their names.

    Rows and hashes are written to the staging folder.  Counting combines before it shuffles.  A
    shard's arrays meet its probes, 40 bytes each, in order of the shard, so that a task holds one
    shard and a batch; a shard whose lines are in very many rows is copied, and each copy answers a
    part of its probes.
    """
    others = [quoted(c) for c in docs.columns if c != out_col]
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(quoted(id_col)).cast("bigint"), F.lit(LEAST_ID)).alias("place"),
            F.struct(*others).alias("doc"),
        ), "line-rows",
    )
    text = F.col(f"doc.{quoted(text_col)}").cast("binary")
    lines = stage(
        rows.select("row", "place", text.alias("text")).mapInArrow(
            _hashed_lines(least_chars), "row bigint, place bigint, h1 bigint, h2 bigint"),
        "line-hashes",
    )
    indexes, shards = recurring_lines(lines, least_documents)
    copies = F.ceil(F.col("probes") / PROBES)
    heads = indexes.select(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)).alias("copy"), "arrays",
        *(F.lit(None).cast("bigint").alias(c) for c in ("row", "place", "h1", "h2")))
    probes = (
        lines.withColumn("shard", _shard(shards)).join(indexes.select("shard", copies.alias("copies")), "shard")
        .select("shard", F.pmod(F.xxhash64("row"), "copies").alias("copy"),
                F.lit(None).cast("binary").alias("arrays"), "row", "place", "h1", "h2")
    )
    lost = (
        heads.unionByName(probes).repartition("shard", "copy")
        .sortWithinPartitions("shard", "copy", F.col("arrays").isNull())
        .mapInArrow(_probed(least_documents), "row bigint, h1 bigint, h2 bigint")
        # a row has as many hashes here as its own text has lines, at most
        .groupBy("row").agg(F.collect_list("h1").alias("h1"), F.collect_list("h2").alias("h2"))
    )
    kept = rows.join(lost, "row", "left").select(
        "doc", F.arrow_udf(_without, _KEPT)(text, "h1", "h2").alias("kept"))
    return kept.select(
        *(F.col("kept.text").alias(c) if c == text_col else F.col(f"doc.{quoted(c)}").alias(c)
          for c in docs.columns if c != out_col),
        F.struct("kept.n_lines", "kept.n_dropped").alias(out_col),
    )
