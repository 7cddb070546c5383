"""Token ids in binary files compressed by a pair grammar (Re-Pair) per block.

A file is a run of blocks.  All numbers are little-endian.  A block is

====================  ==========================================================
4s, 5 x uint32        ``RPB1``, documents, rules, symbols, bytes per symbol, first rule
uint64                ids of all documents of the file before this block
uint8  [documents]    1 where the document has an id
int64  [documents]    document ids
uint32 [documents+1]  first symbol of each document
uint32 [rules, 2]     the two symbols that a rule stands for
uint32 [rules]        number of ids that a rule stands for
uint16/32 [symbols]   the documents, one after the other
====================  ==========================================================

Symbols below the first rule's number are ids, others rules; the number follows the block's
largest id, so that most blocks need two bytes per symbol.  No rule spans two documents, so a
document is decoded from its own symbols, and a range of its ids from those that cover it.

After the blocks stands where each begins and which ids it holds, as ``int64 [blocks, 3]`` (byte,
least id, greatest id), and last ``uint64`` the byte at which that index begins.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from cadence.llm.encoding import Encoder, encoder, tokenizer_json
from cadence.llm.storage import Folder
from cadence.runtime import qualified

HEADER = "<4sIIIIIQ"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"RPB1"
BLOCK_IDS = 1 << 20
"""A block is closed at so many ids; one longer document makes a block of its own."""
FILE_BLOCKS = 64
SLOTS = 1 << 18
"""Pairs are first counted by a hash, so that only those that may be frequent are sorted."""
LEAST_COUNT = 8
"""Pairs that occur less often get no rule."""
SHARE = 16
"""A round replaces pairs that occur at least a so-many-th as often as the most frequent one."""
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


@dataclass
class Grammar:
    symbols: np.ndarray
    first: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    first_rule: int


def _frequent_pairs(symbols: np.ndarray, opens: np.ndarray, share: int):
    """Places, distinct pairs, the pair of each place and counts of the most frequent pairs: those
    of at least a ``share``-th of the greatest count, and ``LEAST_COUNT``.  None if no pair is."""
    slot = (symbols[:-1] * 0x9E3779B1 + symbols[1:]) & (SLOTS - 1)
    slot[opens[1:]] = SLOTS  # not a pair: the second symbol opens a document
    slots = np.bincount(slot, minlength=SLOTS + 1)
    slots[SLOTS] = 0
    least = max(LEAST_COUNT, int(slots.max(initial=0)) // share)
    while True:
        at = np.flatnonzero(slots[slot] >= least)  # no pair occurs more often than its slot
        pairs = (symbols[at] << 32) | symbols[at + 1]
        found, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        # several pairs may have filled the fullest slot; then the bound comes down to the pairs'
        most = int(counts.max(initial=0))
        if most >= least or least == LEAST_COUNT:
            return (at, found, which, counts, least) if most >= least else None
        least = max(LEAST_COUNT, min(least - 1, most) // share)


def build_grammar(ids: np.ndarray, starts: np.ndarray, share: int = SHARE) -> Grammar:
    """Replace frequent pairs by rules, most frequent first, until no pair occurs
    ``LEAST_COUNT`` times.

    Each round counts all neighbouring pairs and replaces, from left to right, those that
    occur at least a ``share``-th as often as the most frequent one.
    """
    symbols, first_rule = ids.astype(np.int64), int(ids.max(initial=0)) + 1
    opens = np.zeros(len(ids) + 1, dtype=bool)
    opens[starts] = True
    opens = opens[:-1]
    rules, lengths = [np.empty((0, 2), np.int64)], np.empty(0, np.int64)
    while (counted := _frequent_pairs(symbols, opens, share)) is not None:
        at, found, which, counts, least = counted
        frequent = counts >= least
        chosen, number = found[frequent], np.cumsum(frequent) - 1
        hit = frequent[which]
        at, place = at[hit], number[which[hit]]
        # of hits that overlap, every other one from the left
        new_run = np.diff(at, prepend=-2) != 1
        run_start = at[new_run][np.cumsum(new_run) - 1]
        even = (at - run_start) % 2 == 0
        at, place = at[even], place[even]
        symbols[at] = first_rule + len(lengths) + place
        kept = np.ones(len(symbols), dtype=bool)
        kept[at + 1] = False
        symbols, opens = symbols[kept], opens[kept]
        parts = np.stack([chosen >> 32, chosen & 0xFFFFFFFF], axis=1)
        known = np.append(lengths, 1)  # the last for ids
        size = known[np.where(parts < first_rule, len(lengths), parts - first_rule)]
        rules.append(parts)
        lengths = np.concatenate([lengths, size.sum(axis=1)])
    first = np.append(np.flatnonzero(opens), len(symbols))
    return Grammar(symbols, first, np.concatenate(rules), lengths, first_rule)


class Block:
    """A block as read from a file; decodes documents or ranges of their ids."""

    def __init__(self, data: bytes, at: int):
        header = struct.unpack_from(HEADER, data, at)
        magic, docs, rules, symbols, width, self.first_rule, self.before = header
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += HEADER_BYTES

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, kind, count, at)
            at += values.nbytes
            return values

        self.has_id, self.doc_ids = take("u1", docs), take("<i8", docs)
        self.first = take("<u4", docs + 1).astype(np.int64)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols).astype(np.int64)
        self.end = at

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        size = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first_rule
        size[rule] = self.lengths[symbols[rule] - self.first_rule]
        return size

    def all_ids(self) -> np.ndarray:
        """The ids of all documents: rules are written out one after the other, a rule's parts
        before it, and copied to where they occur."""
        offset = np.concatenate([[0], np.cumsum(self.lengths)])
        flat, at = np.empty(offset[-1], np.int64), offset.tolist()
        for n, (left, right) in enumerate(self.rules.tolist()):
            to = at[n]
            for part in (left, right):
                k = part - self.first_rule
                if k < 0:
                    flat[to] = part
                    to += 1
                else:
                    size = at[k + 1] - at[k]
                    flat[to:to + size] = flat[at[k]:at[k + 1]]
                    to += size
        size = self.sizes(self.symbols)
        out = np.repeat(self.symbols, size)
        rule = np.repeat(self.symbols >= self.first_rule, size)
        within = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
        out[rule] = flat[offset[out[rule] - self.first_rule] + within[rule]]
        return out.astype("<u4")

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols to ids: rules are replaced by their two parts until none is left, so only
        rules that occur are looked at."""
        while True:
            rule = symbols >= self.first_rule
            if not rule.any():
                return symbols.astype("<u4")
            at = np.cumsum(1 + rule) - 1 - rule  # where each symbol's first part goes
            out = np.empty(len(symbols) + int(rule.sum()), np.int64)
            out[at] = symbols
            parts = self.rules[symbols[rule] - self.first_rule]
            out[at[rule]], out[at[rule] + 1] = parts[:, 0], parts[:, 1]
            symbols = out

    def tokens(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block's document number ``doc``."""
        symbols = self.symbols[self.first[doc]:self.first[doc + 1]]
        ends = np.cumsum(self.sizes(symbols))
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, "<u4")
        low = int(np.searchsorted(ends, start, side="right"))
        high = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[low - 1]) if low else 0
        return self.expand(symbols[low:high])[start - before:stop - before]


def block_bytes(doc_ids: list, ids: list[bytes], before: int) -> bytes:
    tokens = np.frombuffer(b"".join(ids), "<u4")
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    if (sizes == 0).any():
        raise ValueError("each document needs at least its end id")
    grammar = build_grammar(tokens, np.cumsum(sizes) - sizes)
    width = 2 if grammar.first_rule + len(grammar.rules) <= 1 << 16 else 4
    header = struct.pack(
        HEADER, MAGIC, len(ids), len(grammar.rules), len(grammar.symbols), width, grammar.first_rule,
        before,
    )
    return b"".join([
        header,
        np.array([d is not None for d in doc_ids], "u1").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        grammar.first.astype("<u4").tobytes(),
        grammar.rules.astype("<u4").tobytes(),
        grammar.lengths.astype("<u4").tobytes(),
        grammar.symbols.astype(f"<u{width}").tobytes(),
    ])


INDEX = np.dtype([("at", "<i8"), ("least", "<i8"), ("greatest", "<i8")])
LEAST_ID = -(1 << 63)  # where documents without an id stand


def block_index(file) -> np.ndarray:
    """Where the blocks of a file are and which ids they hold, read from its end."""
    file.seek(file.size() - 8)
    begin, = struct.unpack("<Q", file.read(8))
    file.seek(begin)
    return np.frombuffer(file.read(file.size() - 8 - begin), INDEX)


def read_block(file, at: int) -> Block:
    file.seek(at)
    _, docs, rules, symbols, width, _, _ = struct.unpack(HEADER, file.read(HEADER_BYTES))
    length = 9 * docs + 4 * (docs + 1) + 12 * rules + width * symbols
    file.seek(at)
    return Block(file.read(HEADER_BYTES + length), 0)


@dataclass
class Written(WriterCommitMessage):
    part: int
    files: list


class TokenFileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, encode: Callable[[], Encoder], end_id: int):
        self.folder, self.encode, self.end_id = folder, encode, end_id

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        encode, folder = self.encode(), Folder(self.folder)
        part, end = TaskContext.get().partitionId(), np.array([self.end_id], "<u4").tobytes()
        files: list[dict] = []
        out, doc_ids, ids, pending, written, size = None, [], [], 0, 0, 0
        blocks: list[tuple[int, int, int]] = []

        def close() -> None:
            nonlocal out, blocks
            index = np.array(blocks, INDEX)
            out.write(index.tobytes() + struct.pack("<Q", size))
            out.close()
            files[-1].update(
                ids=written, size=size + index.nbytes + 8, least=int(index["least"].min()),
                greatest=int(index["greatest"].max()))
            out, blocks = None, []

        def flush() -> None:
            nonlocal out, doc_ids, ids, pending, written, size
            if not ids:
                return
            if out is None:
                files.append({"name": folder.new_name(part, ".tokens")})
                out, written, size = folder.create(files[-1]["name"]), 0, 0
            data = block_bytes(doc_ids, ids, written)
            out.write(data)
            places = [LEAST_ID if d is None else d for d in doc_ids]
            blocks.append((size, min(places), max(places)))
            written, size = written + pending, size + len(data)
            doc_ids, ids, pending = [], [], 0
            if len(blocks) == FILE_BLOCKS:
                close()

        for batch in iterator:
            for doc_id, own in zip(batch.column(0).to_pylist(), encode.each(batch.column(1))):
                encoded = own + end
                if pending and pending + len(encoded) // 4 > BLOCK_IDS:
                    flush()
                doc_ids.append(doc_id)
                ids.append(encoded)
                pending += len(encoded) // 4
        flush()
        if out is not None:
            close()
        return Written(part, files)

    def commit(self, messages: list[Written]) -> None:
        before, files = 0, []
        for message in sorted((m for m in messages if m), key=lambda m: m.part):
            for file in message.files:
                files.append(file | {"before": before})
                before += file["ids"]
        Folder(self.folder).write_manifest(files)

    def abort(self, messages: list[Written]) -> None:
        Folder(self.folder).delete([f["name"] for m in messages if m for f in m.files])


@dataclass
class TokenFile(InputPartition):
    name: str
    before: int


class TokenFileReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[TokenFile]:
        files = Folder(self.folder).manifest()
        return [TokenFile(f["name"], f["before"]) for f in files] or [TokenFile("", 0)]

    def read(self, partition: TokenFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        with Folder(self.folder).open(partition.name) as file:
            for at in block_index(file)["at"].tolist():
                yield self._rows(read_block(file, at), partition.before)

    @staticmethod
    def _rows(block: Block, before: int) -> pa.RecordBatch:
        ids = block.all_ids()
        sizes = np.cumsum(block.sizes(block.symbols))
        ends = np.concatenate([[0], sizes])[block.first]
        data = ids.tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array(block.doc_ids, pa.int64(), mask=block.has_id == 0),
            pa.array(before + block.before + ends[:-1], pa.int64()),
            pa.array(np.diff(ends), pa.int64()),
            pa.array([data[4 * a:4 * b] for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
        ], ["doc_id", "start", "n_tokens", "ids"])


class TokenFiles(DataSource):
    """Data source ``grammar_tokens``; written by ``write_token_files``."""

    @classmethod
    def name(cls) -> str:
        return "grammar_tokens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenFileReader:
        return TokenFileReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TokenFileWriter:
        spec = tokenizer_json(self.options["tokenizer"])
        return TokenFileWriter(
            self.options["path"], lambda: encoder(spec), int(self.options["end_id"])
        )


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encode whole texts and write them in ascending order of ``id_col`` into a new folder.

    Range partitions keep the order across files; the texts are shuffled once and encoded
    where they arrive.  A null text is an empty one (its end id alone); documents without an
    id come first, equal ids in the order of their texts' hashes, by which many rows of one id are
    cut as well; repeated rows are written repeatedly.  An empty table gives a manifest without
    files.  Other columns are ignored.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(*order).sortWithinPartitions(*order, "text")
    )
    ordered.write.format("grammar_tokens").mode("append").options(
        tokenizer=tokenizer, end_id=end_id
    ).save(qualified(spark, path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: each document's ids (bytes, little-endian unsigned 32
    bits) and the number of ids of all documents before it."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("grammar_tokens").load(qualified(spark, path))


def read_tokens(path: str, doc_id: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Random access from one process: ids ``start`` to ``stop`` of one document, the first of
    that id.  The manifest tells the file, the file's index the block; of that block the symbols
    that cover the range are expanded."""
    folder = Folder(path)
    for listed in folder.manifest():
        if not listed["least"] <= doc_id <= listed["greatest"]:
            continue
        with folder.open(listed["name"]) as file:
            index = block_index(file)
            for at in index["at"][(index["least"] <= doc_id) & (doc_id <= index["greatest"])].tolist():
                block = read_block(file, at)
                own = np.flatnonzero((block.doc_ids == doc_id) & (block.has_id == 1))
                if len(own):
                    return block.tokens(int(own[0]), start, stop)
    raise KeyError(doc_id)
