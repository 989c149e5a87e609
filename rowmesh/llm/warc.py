"""WARC archives as a Spark data source, and a writer that stores equal payloads once.

Every record is a gzip member of its own whose header holds the member's length
(the "sl" field of the format's annex), so a reader can step over a record. A
partition is a file. Predicates on the record type and on header columns are
pushed into the reader: it inflates a record's headers first and neither reads
nor inflates the payload of a record that isn't wanted.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from rowmesh.functions.storage import qualified

from .common import new_folder, written

#: Payloads of fewer bytes are stored anew each time.
MIN_REVISIT = 100
#: Groups of equal payloads whose digests every task holds, at most (about 100 bytes each).
BROADCAST_GROUPS = 200_000
#: A file is closed and a new one begun once it has as many bytes.
ROLL_BYTES = 64 << 20
LEVEL = 4
MANIFEST = "_committed.json"

# Names that the format prescribes.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header columns, and the record's header that each shows.
HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "warc_date": "warc-date",
}
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in HEADERS]
    + [T.StructField("content_length", T.LongType()), T.StructField("payload_length", T.LongType()), T.StructField("payload", T.BinaryType())]
)


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a URI, and the path in it.

    The workers that plan and read a Python source can't ask Hadoop, so a path
    without a scheme is a local one here; write_pages() and read_back() pass the
    URI that Spark itself would use for it.
    """
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return arrow_fs.LocalFileSystem(), uri
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # Hadoop's connectors have their own names for the same store.
    return arrow_fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


# Writing


def _value(text: object) -> str:
    """A header value: line ends can't stand in one."""
    return str(text).replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, record_id: str, url: str | None, date: str, digest: str, length: int, payload: bytes | None, refers_to: str | None = None) -> bytes:
    """One record: a response with its payload, or a revisit with the response's HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_value(record_id)}", f"WARC-Date: {_value(date)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_value(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_value(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with its own and the inflated length in the extra field (0 where they exceed 4 bytes)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    total = 24 + len(body) + 8
    sizes = struct.pack("<II", total, len(data)) if max(total, len(data)) < 2**32 else bytes(8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8) + sizes + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns kind, record_id, url, date, digest, length, payload, refers_to: each task writes files of its own, and the manifest names those that count."""

    def __init__(self, path: str, roll: int):
        self.path, self.roll = path, roll

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        where, folder = _place(self.path)
        where.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size = None, 0
        part = TaskContext.get().partitionId()
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.roll:
                    if out is not None:
                        out.close()
                    names.append(f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = member(record(**row))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        where, folder = _place(self.path)
        where.create_dir(folder, recursive=True)
        with where.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Files | None]) -> None:
        where, folder = _place(self.path)
        for name in (n for m in messages if m for n in m.names):
            where.delete_file(f"{folder}/{name}")


# Reading


class _Window:
    """Bytes of a file by place, fetched in stretches, so that stepping over a record fetches nothing."""

    def __init__(self, file, size: int, stretch: int = 1 << 18):
        self.file, self.size, self.stretch, self.at, self.held = file, size, stretch, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.held):
            self.held, self.at = self.file.read_at(max(n, min(self.stretch, self.size - at)), at), at
        return self.held[at - self.at : at - self.at + n]


class _Member:
    """The inflated bytes of the gzip member at a place, made only as far as they are asked for."""

    def __init__(self, window: _Window, at: int):
        self.window, self.start, self.next = window, at, at
        self.inflater, self.data = zlib.decompressobj(31), bytearray()
        head = window.get(at, 24)
        self.length = struct.unpack("<I", head[16:20])[0] if head[3:4] == b"\x04" and head[12:14] == b"sl" else 0

    def upto(self, done, step: int) -> None:
        """Inflate on until done(data) or the member's end."""
        while not done(self.data) and not self.inflater.eof:
            more = self.inflater.unconsumed_tail
            if not more:
                more = self.window.get(self.next, step)
                if not more:
                    raise EOFError("an archive ends within a record")
                self.next += len(more)
            self.data += self.inflater.decompress(more, step)

    def end(self) -> int:
        """Where the next member begins: from the header, or by inflating to the end."""
        if not self.length:
            self.upto(lambda data: data.clear(), 1 << 16)
            return self.next - len(self.inflater.unused_data)
        return self.start + self.length


def _head(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Header lines from a place to the empty line, names in lower case, and where the rest begins."""
    end = data.find(b"\r\n\r\n", at)
    fields = {}
    for line in bytes(data[at:end]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields, end + 4


def _columns(fields: dict[str, str]) -> dict[str, object]:
    row: dict[str, object] = {c: fields.get(h) for c, h in HEADERS.items()}
    row["content_length"] = int(fields.get("content-length") or 0)
    return row


def read_file(path: str, wanted, payload: bool) -> Iterator[dict[str, object]]:
    """Records of one archive, gzipped by record or plain, for whose header columns wanted(row) holds."""
    where, inner = _place(path)
    with where.open_input_file(inner) as file:
        window = _Window(file, file.size())
        at = 0
        while at < window.size:
            if window.get(at, 2) == b"\x1f\x8b":
                part = _Member(window, at)
                part.upto(lambda data: b"\r\n\r\n" in data, 1024)
                data, whole = part.data, part
            else:
                n = 4096
                while b"\r\n\r\n" not in (data := window.get(at, n)) and n < window.size - at:
                    n *= 2
                whole = None
            fields, begin = _head(data, 0)
            row = _columns(fields)
            length = row["content_length"]
            if wanted(row):
                http = fields.get("content-type", "").startswith("application/http")
                row["payload_length"], row["payload"] = (None if http else length), None
                # The HTTP head comes next; the payload only if it is asked for.
                more = length if payload else min(length, 4096)
                if whole is not None:
                    whole.upto(lambda d: len(d) >= begin + more, 1 << 16)
                    block = memoryview(whole.data)[begin : begin + more]
                else:
                    block = memoryview(window.get(at + begin, more))
                start = 0
                if http:
                    lines, start = _head(bytes(block[: 1 << 16]), 0)
                    row["payload_length"] = int(lines.get("content-length") or length - start)
                if payload and row["warc_type"] != "revisit":
                    row["payload"] = bytes(block[start:])
                block.release()
                yield row
            if whole is None:
                at += begin + length + 4
            else:
                at = whole.end()


_TESTS = {
    EqualTo: lambda v, x: v == x,
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x,
    StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x),
    StringContains: lambda v, x: x in v,
}


@dataclass
class Archive(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what compares a header column with fixed values; the rest stays with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS or name == "content_length":
                if type(f) in (IsNull, IsNotNull):
                    self.tests.append((name, type(f), None))
                    continue
                if type(f) in _TESTS and f.value is not None:
                    self.tests.append((name, type(f), f.value))
                    continue
            yield f

    def partitions(self) -> list[Archive]:
        where, folder = _place(self.path)
        info = where.get_file_info(folder)
        if info.is_file:
            return [Archive(self.path)]
        if where.get_file_info(f"{folder}/{MANIFEST}").is_file:
            with where.open_input_stream(f"{folder}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:
            names = [x.base_name for x in where.get_file_info(arrow_fs.FileSelector(folder)) if x.base_name.endswith((".warc", ".warc.gz"))]
        return [Archive(f"{self.path}/{n}") for n in sorted(names)]

    def wanted(self, row: dict[str, object]) -> bool:
        for name, kind, value in self.tests:
            found = row[name]
            if (found is not None) if kind is IsNull else found is None or kind is not IsNotNull and not _TESTS[kind](found, value):
                return False
        return True

    def read(self, partition: Archive | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file at all
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(SCHEMA)
        rows, size = [], 0
        for row in read_file(partition.path, self.wanted, self.payload):
            rows.append(row)
            size += 500 + len(row["payload"] or b"")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """format("warc"): load(folder or file) with option payload=false to leave payloads out, or save a table of records."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("rollBytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    """Make format("warc") known, and allow Python data sources to take predicates, which this one needs: the only setting that this package touches."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# Pages as archives


def page_records(pages: DataFrame, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of pages, one per row. Of payloads of at least min_revisit bytes that are equal, the one of the least page_id is kept.

    Only the digests of groups of several pages are joined back. While these are few
    they go to every task and no payload is moved; else it is a join on the digest whose
    heavy keys Spark can split. A null html is an empty payload. Rows
    that repeat the least page_id of their group are responses each; a null
    page_id is a revisit unless its group has no id at all.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.cast("binary").alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("length"),
    )
    firsts = keyed.where(F.col("length") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts, "repeated-payloads")
    if firsts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        firsts = F.broadcast(firsts)
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    return keyed.join(firsts, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("kind"), name("page_id").alias("record_id"), "url", F.lit(date).alias("date"), "digest", "length",
        F.when(~again, F.col("payload")).alias("payload"), F.when(again, name("first")).alias("refers_to"),
    )


def write_pages(pages: DataFrame, path: str, **how) -> None:
    """Archives of pages in a folder that all executors reach; no pages give no archive, but a manifest."""
    register(pages.sparkSession)
    path = qualified(pages.sparkSession, path)
    page_records(pages, **how).write.format("warc").mode("append").option("path", path).save()


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archived pages.

    Length and digest of a response are taken from the payload that was read; a
    revisit has none, and gives those in its headers. Each archive is read once.
    """
    register(spark)
    path = qualified(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    response = F.col("warc_type") == "response"
    records = spark.read.format("warc").load(path).where(F.col("warc_type").isin("response", "revisit"))
    return records.select(
        number("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.when(~response, number("refers_to")).alias("refers_to"),
    )


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read them back; see read_back()."""
    path = new_folder(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_back(pages.sparkSession, path)


def oracle() -> str:
    """DuckDB SQL for archived_pages() of `pages`."""
    return f"""
WITH full_pages AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
keyed AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM full_pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM keyed)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
