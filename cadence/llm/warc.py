"""WARC archives as a data source: ``warc``.

Written archives are ``.warc.gz`` files with one gzip member per record.  A member's header
carries the standard's skip lengths (extra field ``sl``), so a reader that has parsed a
record's header can go to the next record without inflating the rest.  Plain ``.warc`` files
and members without skip lengths are read too.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
    IsNotNull, StringStartsWith, WriterCommitMessage,
)

from cadence.llm.storage import Folder
from cadence.runtime import qualified, quoted

FILE_BYTES = 64 << 20
"""A writing task starts a new file at this size."""
PARTITION_BYTES = 128 << 20
"""Small files are read together up to this size."""
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, "
    "payload_digest string, payload_bytes bigint, payload binary"
)
# Header names of the WARC 1.1 standard (fixed values).
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _field(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value)


def record_bytes(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit with HTTP headers only.

    Both name the whole payload's length and digest.
    """
    payload = row["payload"] or b""
    size = len(payload) if row["payload_bytes"] is None else row["payload_bytes"]
    digest = row["payload_digest"] or sha1_base32(payload)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    ).encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {_field(row['record_type'])}",
        f"WARC-Record-ID: {_field(row['record_id'] or '')}", f"WARC-Date: {row['date'] or EPOCH}",
    ]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_field(row['target_uri'])}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        lines.append(f"WARC-Refers-To: {_field(row['refers_to'] or '')}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member with skip lengths; lengths that need more than 32 bits are left out."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
    whole = len(head) + 2 + 12 + len(body) + len(tail)
    if max(whole, len(data)) >= 1 << 32:
        return head[:3] + b"\x00" + head[4:] + body + tail
    extra = b"sl" + struct.pack("<HII", 8, whole, len(data))
    return head + struct.pack("<H", len(extra)) + extra + body + tail


@dataclass
class Archive(WriterCommitMessage):
    part: int
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        folder, part, files, out = Folder(self.folder), TaskContext.get().partitionId(), [], None
        for batch in iterator:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for k in range(batch.num_rows):
                if out is None:
                    files.append({"name": folder.new_name(part, ".warc.gz"), "size": 0})
                    out = folder.create(files[-1]["name"])
                data = gzip_member(record_bytes({c: v[k].as_py() for c, v in columns.items()}))
                out.write(data)
                files[-1]["size"] += len(data)
                if files[-1]["size"] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Archive(part, files)

    def commit(self, messages: list[Archive]) -> None:
        ordered = sorted((m for m in messages if m), key=lambda m: m.part)
        Folder(self.folder).write_manifest([f for m in ordered for f in m.files])

    def abort(self, messages: list[Archive]) -> None:
        Folder(self.folder).delete([f["name"] for m in messages if m for f in m.files])


class _Plain:
    """Bytes of an uncompressed record, from its start."""

    def __init__(self, file, start: int):
        self.file, self.start = file, start

    def read(self, size: int) -> bytes:
        return self.file.read(size)

    def next_start(self, length: int) -> int:
        return self.start + length


class _Member:
    """Inflated bytes of a gzip member, from its start."""

    def __init__(self, file, start: int, first: bytes):
        self.file, self.start, self.whole, self.taken = file, start, None, 0
        flags, at = first[3], 10
        if flags & 4:
            size = struct.unpack_from("<H", first, at)[0]
            extra, at = first[at + 2:at + 2 + size], at + 2 + size
            if extra[:2] == b"sl":
                self.whole = struct.unpack_from("<I", extra, 4)[0]
        for flag in (8, 16):  # a name, a comment
            if flags & flag:
                at = first.index(b"\0", at) + 1
        at += 2 * bool(flags & 2)
        self.inflate = zlib.decompressobj(-zlib.MAX_WBITS)
        self.pending = first[at:]
        self.taken = len(first)

    def read(self, size: int) -> bytes:
        out = b""
        while len(out) < size and not self.inflate.eof:
            data = self.pending or self.file.read(1 << 16)
            if not self.pending:
                self.taken += len(data)
                if not data:
                    raise ValueError("a record ends early")
            out += self.inflate.decompress(data, size - len(out))
            self.pending = self.inflate.unconsumed_tail
        return out

    def next_start(self, length: int) -> int:
        if self.whole is not None:
            return self.start + self.whole
        while not self.inflate.eof:
            self.read(1 << 20)
        return self.start + self.taken - len(self.inflate.unused_data) + 8


def parse_header(head: bytes) -> dict[str, str]:
    """Lower-case names to values; a continued line belongs to the value before it."""
    text = re.sub(rb"\r\n[ \t]+", b" ", head).decode("utf-8", "replace")
    version, *lines = text.split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    pairs = (line.partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def read_records(file, wanted, payload: bool = True, verify: bool = True) -> Iterator[dict]:
    """Records of an open archive whose header ``wanted`` accepts.

    The header is read first.  Payloads are read only for accepted responses, if asked for;
    otherwise the rest of the record is skipped, apart from the HTTP header, which names the
    payload's length.
    """
    total, at = file.size(), 0
    while at < total:
        file.seek(at)
        first = file.read(1 << 12)
        if first[:2] == b"\x1f\x8b":
            record = _Member(file, at, first)
        else:
            file.seek(at)
            record = _Plain(file, at)
        head = b""
        while b"\r\n\r\n" not in head:
            more = record.read(1 << 9)
            if not more:
                raise ValueError("a record's header ends early")
            head += more
        head, _, rest = head.partition(b"\r\n\r\n")
        fields = parse_header(head)
        length = int(fields["content-length"])
        row = {c: fields.get(name.lower()) for c, name in HEADERS.items()}
        if row["payload_digest"]:
            row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
        if wanted(row):
            row |= _block(record, rest, length, row, payload, verify)
            yield row
        at = record.next_start(len(head) + 4 + length + 4)


def _block(record, rest: bytes, length: int, row: dict, payload: bool, verify: bool) -> dict:
    """Length and, where asked for, bytes of the payload."""
    http = row["record_type"] in ("response", "revisit")
    while http and b"\r\n\r\n" not in rest[:length] and len(rest) < length:
        rest += record.read(min(1 << 9, length - len(rest)))
    if http:
        head, found, _ = rest[:length].partition(b"\r\n\r\n")
        named = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head) if found else None
        skip = len(head) + 4 if found else 0
    else:
        named, skip = None, 0
    size = int(named.group(1)) if named else length - skip
    if not payload or row["record_type"] == "revisit":
        return {"payload_bytes": size, "payload": None}
    if len(rest) < length:
        rest += record.read(length - len(rest))
    data = rest[skip:length]
    if verify and row["payload_digest"] and row["payload_digest"] != sha1_base32(data):
        raise ValueError(f"payload of {row['record_id']} differs from its digest")
    return {"payload_bytes": len(data), "payload": data}


@dataclass
class Files(InputPartition):
    names: list


class WarcReader(DataSourceReader):
    """Plans groups of files; takes over equality, membership and prefix tests of headers."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.verify = options.get("verify", "true").lower() != "false"
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None if f.attribute else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "present", ()))
            else:
                yield f

    def partitions(self) -> list[Files]:
        groups, size = [Files([])], 0
        for name, length in Folder(self.folder).listed((".warc", ".warc.gz")):
            if groups[-1].names and size + length > PARTITION_BYTES:
                groups.append(Files([]))
                size = 0
            groups[-1].names.append(name)
            size += length
        return groups

    def wanted(self, row: dict) -> bool:
        for column, kind, values in self.tests:
            value = row[column]
            if value is None or kind == "in" and value not in values:
                return False
            if kind == "starts" and not value.startswith(values):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder, rows, size = Folder(self.folder), [], 0
        for name in partition.names:
            with folder.open(name) as file:
                for row in read_records(file, self.wanted, self.payload, self.verify):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _arrow())
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _arrow())


def _arrow() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c, kinds[k]) for c, k in (x.split() for x in SCHEMA.split(", "))])


class Warc(DataSource):
    """Options: ``path``; ``payload`` false skips payloads; ``verify`` false skips digests."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``record_type`` and ``refers_to``.

    Of rows with equal payloads (null: empty) of at least ``least_bytes`` bytes, those with the
    smallest id are responses and the others revisit it; smaller payloads are responses.  Rows
    that share the smallest id are responses all; a null id revisits unless all are null.
    Existing columns of these names are replaced, all others stay, whatever their names.

    Payloads are grouped by SHA-1 and length; the smallest id is a partial aggregate, and the
    join back may be split where one payload has very many copies.
    """
    columns = [c for c in pages.columns if c not in ("record_type", "refers_to")]
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.select(
        F.struct(*(F.col(quoted(c)) for c in columns)).alias("page"), F.col(id_col).alias("id"),
        F.unhex(F.sha1(payload)).alias("sha"), F.octet_length(payload).alias("size"))
    first = (
        keyed.where(F.col("size") >= least_bytes)
        .groupBy(F.col("sha").alias("s"), F.col("size").alias("n")).agg(F.min("id").alias("first"))
    )
    joined = keyed.join(first, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("n")), "left")
    original = F.col("first").isNull() | F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        *(F.col(f"page.{quoted(c)}").alias(c) for c in columns),
        F.when(original, "response").otherwise("revisit").alias("record_type"),
        F.when(~original, F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of the source's schema into a new folder.

    Columns that are missing count as null; others are ignored.  ``payload`` is the whole
    payload in any record: revisits store its length and digest only.
    """
    records.sparkSession.dataSource.register(Warc)
    kinds = dict(x.split() for x in SCHEMA.split(", "))
    chosen = records.select(*[
        F.col(c).cast(k) if c in records.columns else F.lit(None).cast(k).alias(c)
        for c, k in kinds.items()
    ])
    chosen.write.format("warc").mode("append").save(qualified(records.sparkSession, path))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder; filters on header columns reach the reader.

    For that the session's ``spark.sql.python.filterPushdown.enabled`` is switched on, and stays so.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(qualified(spark, path))


def page_urn(page_id: Column) -> Column:
    """A record id for a page number."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_number(urn: Column) -> Column:
    return F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1).try_cast("bigint")
