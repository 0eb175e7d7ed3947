"""WARC archives: a writer for web pages and a Python data source that reads them back.

Writing: one archive for each partition, one record for each page, each record its own gzip
member, named by the partition and renamed into place when complete, so a retried task
replaces its own file and never leaves half of one.  Of pages with equal payloads of at
least ``least`` bytes the smallest page_id is a response, the others revisits that name it.

Reading: ``spark.read.format("warc")``.  Files are planned into one partition for each
``splitBytes`` of whole files; filters on record_type, warc_type and the header columns
are pushed down.  A record's headers are parsed first; a record that the filters refuse,
or whose payload isn't wanted (``payload=false``), is skipped without decoding it.

Defined cases: a null html is an empty payload; repeated rows of one page share the id, so
the response is still one row's and the rest refer to it; empty tables write no records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from rowsmith.llm._store import Store

SCHEMA = "page_id long, record_type string, record_id string, target_uri string, payload_digest string, refers_to long, payload_bytes long, payload binary"
_HEADERS = {
    "page_id": "WARC-Page-ID", "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To-Page-ID", "payload_bytes": "WARC-Payload-Bytes",
}
_NUMBERS = ("page_id", "refers_to", "payload_bytes")
_BLOCK = 1 << 18


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(path).path
    return pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value holds no line break."""
    return " ".join(value.split())


def record(page_id: int | None, url: str, kind: str, digest: str, refers_to: int | None, size: int, payload: bytes) -> bytes:
    """One WARC/1.1 record with an HTTP response block; a revisit has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Bytes: {size}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] + ([f"WARC-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/part-{context.partitionId():06d}.warc.gz"
        attempt = f"{base}/.part-{context.partitionId():06d}.{context.taskAttemptId()}"
        rows = 0
        with fs.open_output_stream(attempt, compression=None) as out:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, kind, sha1, refers_to, html = (c[i].as_py() for c in batch.columns)
                    payload, digest = (html or "").encode(), base64.b32encode(bytes.fromhex(sha1)).decode()
                    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
                    out.write(packed.compress(record(page_id, url or "", kind, digest, refers_to, len(payload), payload)) + packed.flush())
                    rows += 1
        fs.move(attempt, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], names=["path", "records"])

    return run


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds payload_digest, record_type and refers_to to pages(page_id, url, html).

    A digest's smallest page_id comes from a pre-aggregated minimum.  Joined by digest
    without the html's bytes being moved twice; a digest that many pages share is salted.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "utf-8")))
    salts = 8
    first = rows.where(F.octet_length("html") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(first, ["sha1", "salt"], "left")
    return joined


def write_warc(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the archives now; returns (path, records) of each."""
    joined = typed(pages, least)
    repeated = pages.where("page_id is not null").groupBy("page_id").count().where("count > 1").limit(1).count() > 0
    copy = F.lit(False)
    if repeated:  # of rows that share the smallest id, one is the response
        same = Window.partitionBy("sha1", "page_id").orderBy("url")
        joined, copy = joined.withColumn("nth", F.row_number().over(same)), F.col("nth") > 1
    revisit = F.col("first").isNotNull() & ((F.col("page_id") != F.col("first")) | F.col("page_id").isNull() | copy)
    rows = joined.select("page_id", "url", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "sha1", F.when(revisit, F.col("first")).alias("refers_to"), "html")
    written = rows.mapInArrow(_write(folder), "path string, records long")
    return Store(pages.sparkSession, "warc-list").put(written, "written")


class _File(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Stream:
    """A reader over a WARC file, plain or of gzip members, that can skip without keeping."""

    def __init__(self, raw, compressed: bool):
        self.raw, self.compressed = raw, compressed
        self.buffer, self.decoder = b"", zlib.decompressobj(31) if compressed else None

    def fill(self) -> bool:
        """Appends the next decoded bytes to the buffer; false at the end."""
        while True:
            if self.decoder is not None and self.decoder.eof:
                rest = self.decoder.unused_data
                self.decoder = zlib.decompressobj(31)
            else:
                rest = b""
            data = rest or self.raw.read(_BLOCK)
            if not data:
                return False
            out = self.decoder.decompress(data) if self.compressed else data
            if out:
                self.buffer += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.buffer.find(mark)) < 0:
            if not self.fill():
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts = io.BytesIO()
        while n > 0:
            if not self.buffer and not self.fill():
                break
            parts.write(self.buffer[:n])
            got = min(n, len(self.buffer))
            self.buffer, n = self.buffer[got:], n - got
        return parts.getvalue()

    def skip(self, n: int) -> None:
        while n > 0:
            if not self.buffer and not self.fill():
                return
            got = min(n, len(self.buffer))
            self.buffer, n = self.buffer[got:], n - got


def read_records(raw, compressed: bool, wanted, payload: bool, verify: bool = False) -> Iterator[tuple]:
    """Rows of SCHEMA; wanted(row without payload) decides from the headers alone; verify: a payload must have its digest."""
    stream = _Stream(raw, compressed)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = {}
        for line in head.decode("utf-8", "replace").strip("\r\n").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            fields[key.strip().lower()] = value.strip()
        length = int(fields.get("content-length", "0"))
        row = {}
        for column, header in _HEADERS.items():
            value = fields.get(header.lower())
            if value is not None and column in _NUMBERS:
                value = int(value)
            elif value is not None and column == "payload_digest":
                value = value.removeprefix("sha1:")
            row[column] = value
        if not wanted(row):
            stream.skip(length + 4)
            continue
        body = None
        if payload and row["record_type"] == "response":
            block = stream.take(length)
            at = block.find(b"\r\n\r\n") if "msgtype=response" in fields.get("content-type", "") else -4
            body = block[at + 4 :]
            stream.skip(4)
            if verify and row["payload_digest"] is not None and row["payload_digest"] != base32_sha1(body):
                raise ValueError(f"the payload of {row['record_id']} has not the digest {row['payload_digest']}")
        else:
            stream.skip(length + 4)
        yield (*row.values(), body)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.split = int(options.get("splitbytes", options.get("splitBytes", 128 << 20)))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(row[f.attribute[0]] is not None and (row[f.attribute[0]] == f.value if isinstance(f, EqualTo) else row[f.attribute[0]] in f.value) for f in self.filters)

    def partitions(self) -> list[InputPartition]:
        fs, base = file_system(self.path)
        info = fs.get_file_info(base)
        files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]
        out, size, group = [], 0, []
        for f in sorted(files, key=lambda f: f.path):
            if group and size + f.size > self.split:
                out.append(_File(group))
                size, group = 0, []
            group.append(f.path)
            size += f.size
        return [*out, _File(group)] if group else out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for path in partition.paths if partition is not None else ():
            with fs.open_input_stream(path, compression=None) as raw:
                yield from read_records(raw, path.endswith(".gz"), self.wanted, self.payload, self.verify)


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: payload, splitBytes, verify."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, folder: str, payload: bool = True, **options: str) -> DataFrame:
    # Read by Spark at planning time; without it filters are applied after the scan, with the same rows.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).options(**options).load(folder)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages as archives in the shared folder, reads them back, and checks each payload's digest."""
    spark = pages.sparkSession
    folder = Store(spark, "warc").root + "/archive"
    write_warc(pages, folder, least).count()
    # A small split: each archive holds a partition's pages, and tasks should be many.
    back = read_warc(spark, folder, splitBytes=str(8 << 20), verify="true")
    intact = F.col("payload").isNull() | ((F.octet_length("payload") == F.col("payload_bytes")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.sha1("payload").alias("read_sha1"), intact.alias("intact"))
