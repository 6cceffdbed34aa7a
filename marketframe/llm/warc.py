"""WARC archives as a Python data source: writer, planned reads, pushed-down predicates.

Each record is a gzip member of its own whose header carries the member's compressed and plain length (the "sl"
field of the WARC guidelines for gzip). A reader inflates the record's header only, tests the pushed predicates and
seeks past the rest of a member it does not want. Members without that field are inflated to their end instead.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from marketframe.llm.common import read, shared_folder, stored, utf8

SCHEMA = "record_id string, record_type string, target_uri string, content_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Header of each column that predicates can be pushed to.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "content_type": "Content-Type",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A file is closed once it holds this many bytes; a partition of a read takes files of about as many.
FILE_BYTES = 64_000_000
READ_BYTES = 16_000_000
HEAD_BYTES = 2048
BATCH_BYTES = 4_000_000


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder name or URI."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(value: str) -> str:
    """A value that stays on its header line."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


def member(plain: bytes, level: int = 6) -> bytes:
    """A gzip member with its lengths in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(plain)) < 1 << 32:
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, size, len(plain))
    else:
        head = b"\x1f\x8b\x08\x00" + bytes(4) + b"\x00\xff"
    return head + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {header_value(v)}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    """Writes rows of record_id, target_uri, refers_to and payload; a row with refers_to is a revisit without payload."""

    def __init__(self, path: str, level: int, date: str):
        self.path, self.level, self.date = path, level, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        done: list[list] = []
        file, size = None, 0
        for batch in iterator:
            names = batch.schema.names
            columns = [batch.column(names.index(n)) for n in ("record_id", "target_uri", "refers_to", "payload")]
            for row in range(batch.num_rows):
                record_id, uri, refers, payload = (c[row].as_py() for c in columns)
                payload = payload or b""
                fields = {
                    "WARC-Type": "response" if refers is None else "revisit",
                    "WARC-Record-ID": f"<{record_id}>",
                    "WARC-Date": self.date,
                    "WARC-Target-URI": uri,
                    "WARC-Refers-To": None if refers is None else f"<{refers}>",
                    "WARC-Profile": None if refers is None else REVISIT_PROFILE,
                    "WARC-Payload-Digest": "sha1:" + digest(payload),
                    "WARC-Payload-Length": str(len(payload)),
                    "Content-Type": "application/http; msgtype=response",
                }
                data = member(record(fields, HTTP + payload if refers is None else HTTP), self.level)
                if file is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    file, size = system.open_output_stream(f"{folder}/{name}", compression=None), 0
                file.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    file.close()
                    done.append([name, size])
                    file = None
        if file is not None:
            file.close()
            done.append([name, size])
        message = WriterCommitMessage()
        message.files = done
        return message

    def commit(self, messages: list) -> None:
        """Name the files of the tasks that count; those of failed or repeated tasks are never listed."""
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{uuid.uuid4().hex}.manifest", compression=None) as file:
            file.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list) -> None:
        system, folder = place(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            system.delete_file(f"{folder}/{name}")


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class Reading(io.RawIOBase):
    """A pyarrow file as a raw stream for buffering."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, at, whence=0):
        return self.file.seek(at, whence)

    def tell(self):
        return self.file.tell()

    def readinto(self, buffer):
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def head_of(plain: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and the block's offset; None while the header is not complete."""
    end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in plain[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def records(stream: io.BufferedReader, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records of a .warc or .warc.gz stream whose header ``wanted`` accepts."""
    while True:
        start = stream.tell()
        magic = stream.read(10)
        if not magic:
            return
        if magic[:3] != b"\x1f\x8b\x08":
            stream.seek(start)
            yield from plain_records(stream, wanted)
            return
        size = None
        if magic[3] & 4:
            extra = stream.read(struct.unpack("<H", stream.read(2))[0])
            at = 0
            while at + 4 <= len(extra):
                length = struct.unpack("<H", extra[at + 2 : at + 4])[0]
                if extra[at : at + 2] == b"sl" and length == 8:
                    size = struct.unpack("<I", extra[at + 4 : at + 8])[0]
                at += 4 + length
        if size and magic[3] == 4:
            body = stream.tell()
            left = start + size - 8 - body
            inflate = zlib.decompressobj(-15)
            plain = b""
            while left and (head := head_of(plain)) is None:
                part = stream.read(min(HEAD_BYTES, left))
                left -= len(part)
                plain += inflate.decompress(part)
            head = head_of(plain)
            if head and wanted(head[0]):
                plain += inflate.decompress(stream.read(left)) + inflate.flush()
                yield head[0], plain[head[1] : head[1] + int(head[0].get("content-length", 0))]
            stream.seek(start + size)
        else:
            stream.seek(start)
            inflate = zlib.decompressobj(31)
            parts = []
            while not inflate.eof and (part := stream.read(65_536)):
                parts.append(inflate.decompress(part))
            stream.seek(stream.tell() - len(inflate.unused_data))
            plain = b"".join(parts)
            head = head_of(plain)
            if head and wanted(head[0]):
                yield head[0], plain[head[1] : head[1] + int(head[0].get("content-length", 0))]


def plain_records(stream: io.BufferedReader, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        head = b""
        while line := stream.readline():
            if line == b"\r\n" and head:
                break
            head += line if line.strip() else b""
        if not head:
            return
        fields = head_of(head + b"\r\n")[0]
        length = int(fields.get("content-length", 0))
        if wanted(fields):
            yield fields, stream.read(length)
        else:
            stream.seek(length, 1)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool, read_bytes: int):
        self.path, self.payload, self.verify, self.read_bytes = path, payload, verify, read_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take tests on header columns; the others go back to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, EqualNullSafe)) and isinstance(f.value, str):
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files in groups of about ``read_bytes``: those the manifests name, or all archives of the folder."""
        system, folder = place(self.path)
        found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        files = []
        for info in (i for i in found if i.path.endswith(".manifest")):
            with system.open_input_stream(info.path, compression=None) as file:
                files += [(f"{folder}/{name}", size) for name, size in json.loads(file.read())]
        if not any(i.path.endswith(".manifest") for i in found):
            files = [(i.path, i.size) for i in found if i.path.endswith((".warc", ".warc.gz"))]
        out, held = [[]], 0
        for name, size in sorted(files):
            if out[-1] and held + size > self.read_bytes:
                out.append([])
                held = 0
            out[-1].append(name)
            held += size
        return [Files(names) for names in out]

    def _wanted(self, fields: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            got = column_value(column, fields)
            if got is None or (kind == "in" and got not in value) or (kind == "starts" and not got.startswith(value)):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = place(self.path)
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

        for name in partition.names:
            with system.open_input_file(name) as file:
                for fields, block in records(io.BufferedReader(Reading(file), 1 << 20), self._wanted):
                    values = [column_value(c, fields) for c in HEADERS]
                    payload, length = None, fields.get("warc-payload-length")
                    if fields.get("warc-type") == "response":
                        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                        length = len(payload)
                        if self.verify and digest(payload) != column_value("payload_digest", fields):
                            raise ValueError(f"{name}: payload of {values[0]} does not have the digest its header names")
                    rows.append((*values, None if length is None else int(length), payload if self.payload else None))
                    held += len(block) + 500
                    if held > BATCH_BYTES:
                        yield out()
                        rows.clear()
                        held = 0
        if rows:
            yield out()


def column_value(column: str, fields: dict[str, str]) -> str | None:
    value = fields.get(HEADERS[column].lower())
    if value and column == "payload_digest":
        return value.rpartition(":")[2]
    return value.removeprefix("<").removesuffix(">") if value and column in ("record_id", "refers_to") else value


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` over a folder of archives.

    Options: path; for reads payload (default true), verify (recompute digests, default false), read_bytes; for
    writes level (of gzip, default 6) and date (of the records, default now).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _flag(self, name: str, default: str) -> bool:
        return self.options.get(name, default).lower() == "true"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self._flag("payload", "true"), self._flag("verify", "false"), int(self.options.get("read_bytes", READ_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        return WarcWriter(self.options["path"], int(self.options.get("level", 6)), self.options.get("date", now))


def register(spark: SparkSession) -> None:
    # the process that plans a Python source may lack the driver's module path, so the classes travel whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Rows of pages (page_id, url, html) as WARC records: of equal payloads of at least ``least_bytes`` bytes the
    smallest page_id keeps its payload, others refer to it.

    A missing html is an empty payload, a missing url has no URI header. Rows without a page_id never are the
    smallest; rows that repeat the smallest page_id keep their payload. Digests are counted narrow and only those
    that occur twice are joined back.
    """
    rows = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("counted", F.octet_length("payload") >= least_bytes)
    same = pages.select("page_id", utf8("html").alias("payload")).where(F.octet_length("payload") >= least_bytes)
    same = same.select("page_id", F.unhex(F.sha1("payload")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    # stored before it is joined: only a join of two plain shuffles can split a frequent payload
    same = stored(same.where("n > 1").select("digest", "first"), "same")
    rows = rows.join(same, "digest", "left")
    refers = F.when(F.col("counted") & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return rows.select(F.coalesce(urn(F.col("page_id")), F.lit("urn:page:")).alias("record_id"), F.col("url").alias("target_uri"), urn(refers).alias("refers_to"), "payload")


def archive(pages: DataFrame, path: str, least_bytes: int = 0, level: int = 6) -> None:
    """Write a record per row of ``pages`` to the folder ``path``."""
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").option("path", path).option("level", level).mode("append").save()


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    pages = read(spark, sf_dir, "pages")
    archive(pages, path)
    back = spark.read.format("warc").option("path", path).option("payload", "false").option("verify", "true").load()
    back = back.where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(.+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return back.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


QUERIES = {"op5_warc": op5_warc}
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_ALPHABET}', (('0x' || substr(h, {5 * n + 1}, 5))::bigint >> {s}) % 32 + 1, 1)" for n in range(8) for s in (15, 10, 5, 0))
SQL: dict[str, str] = {
    "op5_warc": f"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as h, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to from d
"""
}
