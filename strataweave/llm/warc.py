"""WARC archives of individually compressed records with a shared dictionary.

Each archive is one .warc.zst file: a leading skippable frame holds a
Zstandard dictionary trained on the archive's own first records (at most
TRAIN_BYTES of them), and every record is a frame of its own, compressed with
it. A task streams its records into archives of about ARCHIVE_BYTES, under a
name that depends on the task's partition alone, and moves each into place
when complete, so a task that runs again leaves the same files.

Equal payloads are found by digest; the row with the largest id keeps the
payload, and the others become revisit records that refer to it.

Archives go to a folder that executors share, by way of pyarrow's file
systems; they are read back through Spark's binaryFile source.

Defined results: null html is an empty payload; a null url is an empty target;
rows without an id are never referred to, and are responses if no row of
their payload has an id; repeated rows of the largest id are all responses;
payloads under `least` bytes are all responses; an empty table gives no rows.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataweave.llm.tables import fresh_path, stored

ARCHIVE_BYTES = 16 << 20
TRAIN_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, date: str, refers_to: int | None = None, revisit: bool = False) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = HEAD if revisit else HEAD + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or nothing where there are too few records for one."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Collects records until there are enough to train on, then compresses each as a frame."""

    def __init__(self, level: int = 3, train_bytes: int = TRAIN_BYTES) -> None:
        self.level, self.train_bytes = level, train_bytes
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.size = self.records = 0
        self.out = io.BytesIO()
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.size += self.out.write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.waiting_bytes += len(data)
        if self.waiting_bytes >= self.train_bytes:
            self._start()

    def _start(self) -> None:
        dictionary = train(self.waiting)
        held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if dictionary:
            frame = zstandard.ZstdCompressor(level=19).compress(dictionary)
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=held, write_content_size=True, write_checksum=True)
        for data in self.waiting:
            self.size += self.out.write(self.compressor.compress(data))
        self.waiting.clear()

    def close(self) -> bytes:
        if not self.compressor:
            self._start()
        return self.out.getvalue()


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a .warc.zst file: header fields and block."""
    at, dictionary = 0, None
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == SKIPPABLE_MAGIC:
            dictionary, at = bytes(content[8 : 8 + size]), 8 + size
            if dictionary[:4] == b"\x28\xb5\x2f\xfd":
                dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=held).stream_reader(memoryview(content)[at:], read_across_frames=True), 1 << 18)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            fields[name] = value.strip()
        size = int(fields["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield fields, block


def with_roles(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """id, url, payload, and refers_to: null for responses."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"), F.sha1(payload).alias("_sha"))
    first = rows.groupBy("_sha").agg(F.max("page_id").alias("_first"))
    other = (F.octet_length("payload") >= least) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(first, "_sha").select("page_id", "url", "payload", F.when(other, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives now; returns archive, records, bytes of each."""
    rows = with_roles(pages, id_col, url, html, least).sortWithinPartitions("page_id", "refers_to", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, base = FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task, done, now = TaskContext.get(), [], None

        def finish(writer: ArchiveWriter) -> None:
            name = f"part-{task.partitionId():06d}-{len(done):05d}.warc.zst"
            data = writer.close()
            draft = f"{base}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, f"{base}/{name}")
            done.append((name, writer.records, len(data)))

        for batch in batches:
            for page_id, target, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                now = now or ArchiveWriter()
                ref = refers_to.as_py()
                now.add(record(page_id.as_py(), target.as_py(), payload.as_py(), date, ref, ref is not None))
                if now.size >= archive_bytes:
                    finish(now)
                    now = None
        if now:
            finish(now)
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "records", "bytes"])

    return stored(rows.mapInArrow(run, "archive string, records bigint, bytes bigint"), "archive-list")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives in folder: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to. Payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        whole = lambda fields, name: int(fields[name]) if name in fields else None
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in read_archive(content.as_buffer().to_pybytes()):
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    out.append((whole(fields, "X-Page-Id"), fields["WARC-Target-URI"], n, digest, fields["WARC-Type"], whole(fields, "X-Refers-To-Page-Id")))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return files.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives pages in the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    written = write_archives(pages, folder, least=least)
    found = read_archives(spark, folder) if written.count() else None
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return spark.createDataFrame([], schema) if found is None else found.drop("url")
