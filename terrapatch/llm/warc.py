"""WARC archives as a PySpark data source.

`spark.read.format("warc").load(path)` plans its partitions from the files (a small file is
read with others), evaluates filters on record types and headers while a record's header is
all that has been read, and steps over the block of any record that they reject or whose
payload nobody asks for.  `df.write.format("warc").save(path)` writes a file or more for each
task and publishes the files of successful tasks only.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import os
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from terrapatch.llm import common

#: A task begins a new file beyond so many bytes.
ROLL = 128 << 20
#: Files up to so many bytes together are one partition.
TOGETHER = 32 << 20
READ = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, profile string, content_length long, http_length long, payload binary"
WRITE = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload binary"
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "profile": "WARC-Profile"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a path or URI; bare paths and file: URIs are local."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), os.path.normpath(unquote(parts.path))
    return pafs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header's value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """A record: headers, then an HTTP response whose body revisits leave out."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = http if revisit else http + payload
    head = ["WARC/1.1"]
    for name, header in HEADERS.items():
        value = REVISIT if name == "profile" and revisit else row.get(name)
        if value is not None:
            head.append(f"{header}: {_line(('sha1:' if name == 'payload_digest' else '') + value)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A record as a gzip member of its own whose header says how long it is (the "sl" field), so that readers can step over it."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    if size >= 1 << 32 or len(data) >= 1 << 32:
        return gzip.compress(data, 1)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, zipped: bool):
        self.path, self.overwrite, self.zipped, self.job = path, overwrite, zipped, uuid.uuid4().hex

    def write(self, iterator):
        fs, root = filesystem(self.path)
        folder = f"{root}/_temporary-{self.job}"
        fs.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > ROLL:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc{'.gz' * self.zipped}")
                    out, size = fs.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                data = record(row)
                if self.zipped:
                    data = member(data)
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        fs, root = filesystem(self.path)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if f.is_file:
                    fs.delete_file(f.path)
        fs.create_dir(root, recursive=True)
        for m in messages:
            for name in m.files if m else []:
                fs.move(f"{root}/_temporary-{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, root = filesystem(self.path)
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(f"{root}/_temporary-{self.job}")


@dataclass
class Files(InputPartition):
    paths: list

    def __init__(self, paths):
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str]):
        self.path, self.fields, self.tests = path, fields, []

    def pushFilters(self, filters):
        """Keep the filters on headers; give the rest back to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "some", None))
            else:
                yield f

    def partitions(self):
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True)) if f.is_file and f.path.endswith((".warc", ".warc.gz"))]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda f: f.path):
            if held and size + f.size > TOGETHER:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Files(held)] if held else out or [Files([])]

    def read(self, partition):
        fs, _ = filesystem(self.path)
        kind = {"content_length": pa.int64(), "http_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(f, kind.get(f, pa.string())) for f in self.fields])
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for row in self.members(raw) if path.endswith(".gz") else self.records(_Seekable(raw)):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= 1000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def wanted(self, head: dict) -> bool:
        for name, how, what in self.tests:
            value = head.get(name)
            if value is None or how == "in" and value not in what or how == "starts" and not value.startswith(what):
                return False
        return True

    def members(self, raw):
        """Rows of gzip members: of those that say how long they are no more is inflated than is looked at; from the first other one on, all."""
        at, size = 0, raw.size()
        while at < size:
            raw.seek(at)
            head = raw.read(24)
            if head[3:4] != b"\x04" or head[12:14] != b"sl":
                raw.seek(at)
                yield from self.records(gzip.GzipFile(fileobj=raw))
                return
            length = struct.unpack("<I", head[16:20])[0]
            yield from self.records(_Member(raw, length - 32))
            at += length

    def records(self, stream):
        """Rows of the records that pass; the blocks of others are stepped over, not read."""
        names = {h.lower(): n for n, h in HEADERS.items()}
        whole = "payload" in self.fields
        while True:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            head: dict = {}
            length = 0
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                key, _, value = line.decode("utf-8", "replace").partition(":")
                key, value = key.strip().lower(), value.strip()
                if key == "content-length":
                    length = int(value)
                elif key in names:
                    head[names[key]] = value.removeprefix("sha1:") if key == "warc-payload-digest" else value
            if not self.wanted(head):
                stream.seek(length, 1)
                continue
            row = {f: head.get(f) for f in self.fields}
            at = 0
            if "http_length" in self.fields or whole:
                while at < length:
                    line = stream.readline()
                    at += len(line)
                    if line in (b"\r\n", b"\n", b""):
                        break
                    key, _, value = line.partition(b":")
                    if key.strip().lower() == b"content-length" and "http_length" in row:
                        row["http_length"] = int(value)
            if "content_length" in row:
                row["content_length"] = length
            if whole and head.get("record_type") != "revisit":
                row["payload"] = stream.read(length - at)
            else:
                stream.seek(length - at, 1)
            yield row


class _Seekable:
    """Buffered lines over an Arrow file, with relative seeks that read nothing."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.buf, self.at = raw, size, b"", 0

    def readline(self) -> bytes:
        end = self.buf.find(b"\n", self.at)
        while end < 0:
            more = self.raw.read(self.size)
            if not more:
                end = len(self.buf) - 1
                break
            self.buf, self.at = self.buf[self.at :] + more, 0
            end = self.buf.find(b"\n")
        out = self.buf[self.at : end + 1]
        self.at = end + 1
        return out

    def read(self, n: int) -> bytes:
        out = self.buf[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n and (more := self.raw.read(n - len(out))):
            out += more
        return out

    def seek(self, n: int, whence: int) -> None:
        here = len(self.buf) - self.at
        if n <= here:
            self.at += n
        else:
            self.buf, self.at = b"", 0
            self.raw.seek(self.raw.tell() + n - here)


class _Member:
    """Lines and bytes of one gzip member, inflated as far as they are asked for; what is stepped over is the rest of it."""

    def __init__(self, raw, length: int):
        self.raw, self.left, self.inflate, self.buf = raw, length, zlib.decompressobj(-15), b""

    def more(self) -> bool:
        data = self.inflate.unconsumed_tail
        if not data and self.left > 0:
            data = self.raw.read(min(self.left, 1 << 14))
            self.left -= len(data)
        out = self.inflate.decompress(data, 1 << 16) if data else b""
        self.buf += out
        return bool(data)

    def readline(self) -> bytes:
        while (end := self.buf.find(b"\n")) < 0 and self.more():
            pass
        out = self.buf[: end + 1] if end >= 0 else self.buf
        self.buf = self.buf[len(out) :]
        return out

    def read(self, n: int) -> bytes:
        parts = [self.buf[:n]]
        self.buf, have = self.buf[n:], len(parts[0])
        while have < n and self.more():
            parts.append(self.buf[: n - have])
            have += len(parts[-1])
            self.buf = self.buf[len(parts[-1]) :]
        return b"".join(parts)

    def seek(self, n: int, whence: int) -> None:
        self.buf, self.left, self.inflate = b"", 0, zlib.decompressobj(-15)


class WarcSource(DataSource):
    """Options: path; zip ("true": each record is a gzip member of its own)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite, self.options.get("zip", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32(digits):
    """Base 32 of the 40 hexadecimal digits of a SHA-1, 5 bits at a time."""
    parts = []
    for k in range(4):
        part = F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.shiftright(part, 5 * j).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for j in range(7, -1, -1)]
    return F.concat(*parts)


def archived(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write a record for each page; of equal payloads of at least `least` bytes the page of smallest id is the response, and the others revisit it.

    A null html is an empty payload. Pages without an id are responses, and no page revisits them. Rows that repeat
    the smallest id and the payload are responses each. An empty table writes no record. Other columns are not read.
    """
    spark = pages.sparkSession
    register(spark)
    common.small_batches(spark)
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("sha", F.sha1("payload")).withColumn("n", F.length("payload"))
    first = keyed.select("sha", "n", "id").where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    first = common.written(first.where("times > 1").drop("times"), "warc-first")
    names = keyed.join(first.hint("shuffle_merge"), ["sha", "n"], "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), c.cast("string"), F.lit(">"))
    out = names.select(
        F.coalesce(urn(F.col("id")), F.lit("<urn:x-page:>")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("2026-01-01T00:00:00Z").alias("date"),
        "sha",
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload",
    )
    out.withColumn("payload_digest", base32(F.col("sha"))).select(*[c.split()[0] for c in WRITE.split(", ")]).write.format("warc").option("zip", "true").mode("append").save(path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a response's are those of the payload it holds.

    Two scans with a pushed filter on the type: responses with their payloads, revisits by their headers alone, whose
    blocks and all responses are stepped over. An archive without records gives no rows; records of pages without an id
    have a null page_id; records that are repeated in the archive are repeated here.
    """
    register(spark)
    number = lambda c: F.regexp_extract(F.col(c), r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    records = lambda kind, columns: spark.read.format("warc").schema(columns).load(path).where(F.col("record_type") == kind)
    held = records("response", "record_id string, record_type string, payload binary").select(
        number("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    )
    again = records("revisit", "record_id string, record_type string, payload_digest string, refers_to string, http_length long").select(
        number("record_id").alias("page_id"), F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
    return held.unionByName(again)
