"""WARC files as a Spark Python data source, with payload deduplication by revisit records.

Reading plans one partition per run of files, reads record headers first, tests the pushed filters on them and seeks
past (or inflates without decoding) the payloads it does not need; the payload column is decoded only when the
schema asked for it. Writing gives each task its own files, rolled at `max_bytes`.

Records are WARC/1.1, one gzip member each when `compress` is true. A `response` holds an HTTP header and the payload, a
`revisit` only the HTTP header and `WARC-Refers-To`; both carry `WARC-Payload-Digest` and the payload's full length.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from geoseries.llm.common import rows_of, staged

FORMAT = "warc"
#: Column of the source and the WARC header it comes from (fixed values of the format).
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_bytes": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'payload_bytes' else 'string'}" for c in HEADERS) + ", payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CHUNK = 1 << 16


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    """A header value may not break its line."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in value)


def record(fields: dict[str, str | None], block: bytes) -> bytes:
    head = "".join(f"{name}: {_one_line(value)}\r\n" for name, value in fields.items() if value is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class RecordStream:
    """Records of one file in order: headers first, the block only on demand."""

    def __init__(self, source, compressed: bool):
        self.source, self.compressed = source, compressed
        self.buffer, self.inflater, self.skipped, self.ended = b"", None, 0, False

    def _fill(self) -> bool:
        data = self.inflater.unused_data if self.inflater is not None and self.inflater.eof else b""
        if self.compressed:
            if self.inflater is None or self.inflater.eof:
                self.inflater = zlib.decompressobj(31)
            data = data or self.source.read(CHUNK)
            if data:
                self.buffer += self.inflater.decompress(data)
            return bool(data)
        data = self.source.read(CHUNK)
        self.buffer += data
        return bool(data)

    def _line_end(self) -> int:
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._fill():
                return -1
        return at

    def _take(self, count: int) -> bytes:
        parts, have = [], 0
        while have < count:
            if not self.buffer and not self._fill():
                raise ValueError("a WARC record ends early")
            piece, self.buffer = self.buffer[: count - have], self.buffer[count - have :]
            parts.append(piece)
            have += len(piece)
        return b"".join(parts)

    def skip(self, count: int) -> None:
        """Leave `count` bytes out; plain files seek over them."""
        held = min(count, len(self.buffer))
        self.buffer = self.buffer[held:]
        count -= held
        if not self.compressed and count:
            self.source.seek(self.source.tell() + count)
            return
        while count:
            if not self.buffer and not self._fill():
                raise ValueError("a WARC record ends early")
            held = min(count, len(self.buffer))
            self.buffer, count = self.buffer[held:], count - held

    def __iter__(self) -> Iterator[tuple[dict[str, str], int]]:
        """Header fields and block length; the caller reads or skips the block, then the next record follows."""
        while (at := self._line_end()) >= 0:
            lines = self.buffer[:at].decode("utf-8", "replace").split("\r\n")
            self.buffer = self.buffer[at + 4 :]
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
            yield fields, int(fields["content-length"])
            self.skip(4)

    def block(self, length: int) -> bytes:
        return self._take(length)


@dataclass
class FileRun(InputPartition):
    files: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def _matches(filters, fields: dict[str, str]) -> bool:
    for f in filters:
        value = fields.get(HEADERS[f.attribute[0]].lower())
        if value is None:
            return False
        if isinstance(f, EqualTo) and value != f.value:
            return False
        if isinstance(f, In) and value not in f.value:
            return False
        if isinstance(f, StringStartsWith) and not value.startswith(f.value):
            return False
    return True


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.uri, self.names = options["path"], schema.names
        self.run_bytes = int(options.get("partition_bytes", 64 << 20))
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            text = len(f.attribute) == 1 and f.attribute[0] in HEADERS and f.attribute[0] != "payload_bytes"
            if text and isinstance(f, EqualTo | In | StringStartsWith | IsNotNull):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        store, folder = fs.FileSystem.from_uri(self.uri)
        found = [i for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name.endswith((".warc", ".warc.gz")) and i.base_name[0] != "."]
        runs, size = [[]], 0
        for info in sorted(found, key=lambda i: i.path):
            if runs[-1] and size + info.size > self.run_bytes:
                runs.append([])
                size = 0
            runs[-1].append(info.path)
            size += info.size
        return [FileRun(r) for r in runs]

    def read(self, partition):
        store, _ = fs.FileSystem.from_uri(self.uri)
        wanted = "payload" in self.names
        for path in partition.files:
            with store.open_input_file(path) as source:
                records = RecordStream(source, path.endswith(".gz"))
                for fields, length in records:
                    if not _matches(self.filters, fields):
                        records.skip(length)
                        continue
                    row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
                    row["payload_bytes"] = None if row["payload_bytes"] is None else int(row["payload_bytes"])
                    row["payload"] = None
                    if wanted and row["record_type"] == "response":
                        row["payload"] = records.block(length).partition(b"\r\n\r\n")[2]
                    else:
                        records.skip(length)
                    yield tuple(row[n] for n in self.names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.uri, self.compress = options["path"], options.get("compress", "true") == "true"
        self.max_bytes = int(options.get("max_bytes", 256 << 20))

    def write(self, batches):
        store, folder = fs.FileSystem.from_uri(self.uri)
        store.create_dir(folder)
        part, files, sink, size = TaskContext.get().partitionId(), [], None, 0
        for batch in rows_of(batches):
            for row in batch.to_pylist():
                if sink is None or size > self.max_bytes:
                    if sink is not None:
                        sink.close()
                    end = ".warc.gz" if self.compress else ".warc"
                    files.append((f"{folder}/.{uuid.uuid4().hex}{end}", f"{folder}/part-{part:06d}-{len(files):04d}{end}"))
                    sink, size = store.open_output_stream(files[-1][0], compression=None), 0
                data = _page_record(row)
                if self.compress:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                sink.write(data)
                size += len(data)
        if sink is not None:
            sink.close()
        return Written(files)

    def commit(self, messages):
        """Only files of tasks that count get their final names."""
        store, _ = fs.FileSystem.from_uri(self.uri)
        for own, final in (pair for m in messages if m for pair in m.files):
            store.move(own, final)

    def abort(self, messages):
        store, _ = fs.FileSystem.from_uri(self.uri)
        for own, _ in (pair for m in messages if m for pair in m.files):
            store.delete_file(own)


def _page_record(row: dict) -> bytes:
    payload = row["payload"] or b""
    revisit = row["refers_to"] is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": row["record_id"],
        "WARC-Date": row["warc_date"] or DATE,
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": f"sha1:{row['payload_digest'] or digest_of(payload)}",
        "X-Payload-Length": str(len(payload)),
        "WARC-Refers-To": row["refers_to"],
        "WARC-Profile": PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
    }
    return record(fields, HTTP if revisit else HTTP + payload)


class WarcDataSource(DataSource):
    """`spark.read.format("warc").load(uri)`; also a sink for rows of the same columns."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let Spark push filters into Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_headers(spark: SparkSession, uri: str) -> DataFrame:
    """All columns but the payload, which is then skipped, never decoded."""
    register(spark)
    return spark.read.format(FORMAT).schema(SCHEMA.removesuffix(", payload binary")).load(uri)


def read_payloads(spark: SparkSession, uri: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).load(uri)


def urn(key):
    return F.concat(F.lit("<urn:page:"), key.cast("string"), F.lit(">"))


def from_urn(value):
    return F.regexp_extract(value, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archive_pages(pages: DataFrame, uri: str, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0) -> None:
    """Write one record per page. Of equal payloads of at least `min_revisit` bytes, that with the smallest id is a
    response and the others revisit it; shorter ones are all responses.

    A null html is an empty payload, a null url gives no WARC-Target-URI. A page without an id revisits a page that has one,
    and is a response where none has. Rows that repeat the smallest id are all responses. Other columns are not read.
    """
    register(pages.sparkSession)
    source = pages.select(
        F.col(f"`{key}`").cast("long").alias("id"),
        F.col(f"`{url}`").alias("target_uri"),
        F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.unhex(F.sha1("payload")))
    copies = source.filter(F.length("payload") >= min_revisit).groupBy("sha1")
    # One small row per payload that occurs more than once; staged, so that a hot payload's side of the join can be split.
    first = staged(copies.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "payloads")
    ids = source.join(first, "sha1", "left")
    (
        ids.select(
            urn(F.coalesce(F.col("id").cast("string"), F.lit("none"))).alias("record_id"),
            F.lit(None).cast("string").alias("record_type"),
            "target_uri",
            F.lit(DATE).alias("warc_date"),
            _base32("sha1").alias("payload_digest"),
            F.when(~F.col("id").eqNullSafe(F.col("first")), urn(F.col("first"))).alias("refers_to"),
            F.length("payload").cast("long").alias("payload_bytes"),
            "payload",
        )
        .write.format(FORMAT)
        .mode("append")
        .option("path", uri)
        .save()
    )


def _base32(column: str):
    """Upper-case base32 of a 20-byte digest: eight groups of 20 bits, four characters each."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = F.hex(column)
    characters = []
    for group in range(8):
        bits = F.conv(F.substring(digits, 1 + 5 * group, 5), 16, 10).cast("int")
        for k in range(4):
            characters.append(F.substring(F.lit(alphabet), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*characters)


def page_records(spark: SparkSession, uri: str) -> DataFrame:
    """Per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to; payloads are skipped."""
    return read_headers(spark, uri).select(
        from_urn(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        from_urn(F.col("refers_to")).alias("refers_to"),
    )
