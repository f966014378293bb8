"""Web archives (WARC) compressed record by record with a dictionary of their own.

An archive begins with a skippable frame that holds a Zstandard dictionary, built
from the first ``SAMPLE_BYTES`` of the records of that archive; after it each record
is a frame of its own. Short pages of one site share most of their markup, so the
dictionary saves what a frame alone cannot, and a reader can still start at any
record. The bound on the sample changes the size of files, never what they hold.

Of pages with equal payloads of at least ``min_bytes`` bytes the one with the
smallest page_id is a ``response`` with the payload; the others are ``revisit``
records that name it. Payloads are compared by length and SHA-256. Payloads met by at least
one page in ``HEAVY`` are at most ``HEAVY``; they are broadcast and their pages are
dealt by page_id, so no group of copies meets in one task. Payloads of revisits are
not written. No table of pages is sorted or held whole.

A task writes archives of its own names, each up to ``bytes_per_file`` of records,
and hands Spark their index rows (``INDEX``: file, offset, size, page_id, record_type).
Only files that the committed index names are read, so repeated or lost tasks leave
nothing that counts. The reader takes everything from the archives and checks each
length and digest. Files go through pyarrow's file systems (mounted paths, hdfs, s3, gs).

Defined cases: NULL html is an empty payload. NULL page_ids are never the smallest
where others exist; rows that share the smallest page_id of a payload are all
responses, with equal record ids. A NULL url leaves out WARC-Target-URI; line breaks
in a url are written as %0D and %0A. An empty table makes no archive and an empty
index. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderboard.llm.tables import stored

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"

SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
MIN_SAMPLES = 64
LEVEL = 3
BYTES_PER_FILE = 64 << 20
HEAVY = 1000
CAPTURED = "1970-01-01T00:00:00Z"

INDEX = "file string, offset long, size long, page_id long, record_type string"
READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)


class CorruptArchive(ValueError):
    """An archive whose frames, lengths or digests do not agree."""


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


def with_first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, its size, digest (SHA-1, hex) and refers_to: for a copy
    the smallest page_id of its payload, and no payload; else NULL."""
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns({
        "size": F.octet_length("payload").cast("long"),
        "digest": F.sha1(F.col("payload").cast("binary")),
        "key": F.when(F.octet_length("payload") >= min_bytes, F.unhex(F.sha2("payload", 256))),
    })
    copies = stored(
        keyed.filter(F.col("key").isNotNull())
        .groupBy("key", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1"),
        "warc-copies",
    )
    often = F.col("times") * HEAVY >= pages.count()
    heavy = copies.filter(often).select(F.col("key").alias("heavy_key"), F.col("first").alias("heavy_first"))
    light = copies.filter(~often).select(F.col("key").alias("light_key"), F.col("first").alias("light_first"))
    found = keyed.join(F.broadcast(heavy), F.col("key") == F.col("heavy_key"), "left")  # at most HEAVY rows
    # Pages whose payload is heavy, or too small, have a key that meets nothing, one for each id.
    alone = F.unhex(F.sha1(F.concat_ws("|", F.col("page_id").cast("string"), "url").cast("binary")))
    met = F.when(F.col("heavy_key").isNull(), F.col("key"))
    found = found.withColumn("met", F.coalesce(met, alone)).join(light, F.col("met") == F.col("light_key"), "left")
    first = F.coalesce("heavy_first", "light_first")
    copy = F.coalesce(first != F.col("page_id"), first.isNotNull())
    return found.withColumn("copy", copy).select(
        "page_id",
        "url",
        F.when(~F.col("copy"), F.col("payload").cast("binary")).alias("payload"),
        "size",
        "digest",
        F.when(F.col("copy"), first).alias("refers_to"),
    )


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_urn(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}').urn}>"


def record(
    page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None,
    captured: str = CAPTURED,
) -> bytes:
    """One WARC record; without a payload a revisit, which keeps the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {RESPONSE if payload is not None else REVISIT}"]
    head += [f"WARC-Record-ID: {record_urn(page_id, digest)}", f"WARC-Date: {captured}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_urn(refers_to, digest)}"]
        head.append(f"Refers-To-Page-ID: {refers_to}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of these records; empty where they are too few or too plain for one.

    The builder wants many samples, so few records are given to it several times. A
    dictionary of more than a tenth of the records would cost more than it saves.
    """
    samples = records * -(-MIN_SAMPLES // len(records))
    size = min(size, max(1 << 10, sum(map(len, records)) // 10))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


class Stored(NamedTuple):
    """An index row."""

    file: str
    offset: int
    size: int
    page_id: int | None
    record_type: str


class ArchiveWriter:
    """Archives of one task; at most a sample of records waits for its dictionary."""

    def __init__(self, folder: str, prefix: str, bytes_per_file: int = BYTES_PER_FILE) -> None:
        self._system, self._place = _open(folder)
        self._system.create_dir(self._place, recursive=True)
        self._prefix, self._limit = prefix, bytes_per_file
        self._written: list[Stored] = []
        self._reset()

    def _reset(self) -> None:
        self._out, self._waiting, self._held, self._total = None, [], 0, 0

    def add(self, page_id: int | None, record_type: str, data: bytes) -> None:
        self._total += len(data)
        if self._out is None:
            self._waiting.append((page_id, record_type, data))
            self._held += len(data)
            if self._held >= SAMPLE_BYTES:
                self._begin()
        else:
            self._put(page_id, record_type, data)
        if self._total >= self._limit:
            self.close()

    def _begin(self) -> None:
        self._file = f"{self._prefix}-{uuid.uuid4().hex}.warc.zst"
        self._out = self._system.open_output_stream(f"{self._place}/{self._file}", compression=None)
        found = build_dictionary([data for _, _, data in self._waiting])
        options = {}
        if found:
            options["dict_data"] = zstandard.ZstdCompressionDict(found)
            options["dict_data"].precompute_compress(level=LEVEL)
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
        self._out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(found)) + found)
        self._offset = 8 + len(found)
        waiting, self._waiting = self._waiting, []
        for each in waiting:
            self._put(*each)

    def _put(self, page_id: int | None, record_type: str, data: bytes) -> None:
        frame = self._zstd.compress(data)
        self._out.write(frame)
        self._written.append(Stored(self._file, self._offset, len(frame), page_id, record_type))
        self._offset += len(frame)

    def close(self) -> None:
        """End the archive; the next record begins another."""
        if self._out is None and self._waiting:
            self._begin()
        if self._out is not None:
            self._out.close()
        self._reset()

    def take(self) -> pa.RecordBatch:
        """The index rows since the last call."""
        columns = list(zip(*self._written, strict=True)) or [()] * len(Stored._fields)
        self._written = []
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=list(Stored._fields))


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, bytes_per_file: int = BYTES_PER_FILE, captured: str = CAPTURED
) -> None:
    """Write ``folder/archives`` and ``folder/index``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            if writer is None:
                part = TaskContext.get().partitionId()
                writer = ArchiveWriter(f"{folder}/archives", f"pages-{part:06d}", bytes_per_file)
            ids, urls, payloads, sizes, digests, copied = (batch.column(i) for i in range(6))
            for i in range(batch.num_rows):
                payload, digest = payloads[i].as_py(), base32(bytes.fromhex(digests[i].as_py()))
                page_id, refers_to = ids[i].as_py(), copied[i].as_py()
                data = record(page_id, urls[i].as_py(), payload, sizes[i].as_py(), digest, refers_to, captured)
                writer.add(page_id, RESPONSE if payload is not None else REVISIT, data)
            yield writer.take()
        if writer is not None:
            writer.close()
            yield writer.take()

    rows = with_first_copies(pages, min_bytes)
    rows = rows.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})
    rows.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def dictionary_of(source: io.IOBase | pa.NativeFile) -> zstandard.ZstdCompressionDict | None:
    """The dictionary that an archive begins with; the frames follow it."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE_MAGIC:
        raise CorruptArchive("no dictionary frame at the beginning")
    found = source.read(struct.unpack("<I", head[4:])[0])
    if found and not found.startswith(DICTIONARY_MAGIC):
        found = zstandard.ZstdDecompressor().decompressobj().decompress(found)
    return zstandard.ZstdCompressionDict(found) if found else None


def _fields(lines: Iterator[bytes]) -> dict[str, str]:
    """Named fields up to an empty line."""
    found = {}
    for line in lines:
        if not line.rstrip(b"\r\n"):
            return found
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    raise CorruptArchive("the archive ends within a header")


def parse_record(source: io.BufferedReader) -> tuple | None:
    """The next record as a row of ``READ``; None at the end of the archive."""
    version = source.readline()
    if not version:
        return None
    if version.rstrip() != b"WARC/1.1":
        raise CorruptArchive(f"not a record: {version[:40]!r}")
    head = _fields(iter(source.readline, b""))
    length = int(head["content-length"])
    block = source.read(length)
    if len(block) < length or source.read(4) != b"\r\n\r\n":
        raise CorruptArchive(f"record {head.get('warc-record-id')} is cut short")
    inner = io.BytesIO(block)
    inner.readline()
    size = int(_fields(iter(inner.readline, b""))["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if head["warc-type"] == RESPONSE:
        payload = inner.read()
        if len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest:
            raise CorruptArchive(f"payload of record {head.get('warc-record-id')} differs from its digest")

    def number(name: str) -> int | None:
        return int(head[name]) if name in head else None

    return (
        number("page-id"), head.get("warc-target-uri"), size, digest, head["warc-type"],
        number("refers-to-page-id"), payload,
    )


def records_of(source: io.IOBase | pa.NativeFile) -> Iterator[tuple]:
    """All records of one archive, decompressed as they are read."""
    found = dictionary_of(source)
    zstd = zstandard.ZstdDecompressor(**({"dict_data": found} if found else {}))
    stream = io.BufferedReader(zstd.stream_reader(source, read_across_frames=True, closefd=False), 1 << 18)
    while (row := parse_record(stream)) is not None:
        yield row


def record_at(source: io.IOBase | pa.NativeFile, offset: int, size: int) -> tuple:
    """The record of one index row, without reading those before it."""
    found = dictionary_of(source)
    source.seek(offset)
    zstd = zstandard.ZstdDecompressor(**({"dict_data": found} if found else {}))
    data = zstd.decompressobj().decompress(source.read(size))
    return parse_record(io.BufferedReader(io.BytesIO(data)))


def read_archives(spark: SparkSession, folder: str, payloads: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the committed archives, one task for each archive at a time.

    Without ``payloads`` these are checked but not returned.
    """
    schema = READ if payloads else READ.removesuffix(", payload binary")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [field.split()[0] for field in READ.split(", ")]
    width = len(names) if payloads else len(names) - 1

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))[:width]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds[:width], strict=True)], names=names[:width]
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, place = _open(f"{folder}/archives")
                rows, held = [], 0
                with system.open_input_stream(f"{place}/{file}", compression=None) as source:
                    for row in records_of(source):
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                        if held >= batch_bytes:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = stored(read_index(spark, folder).select("file").distinct(), "warc-files")
    count = max(1, files.count())
    return files.repartitionByRange(count, "file").mapInArrow(read, schema)
