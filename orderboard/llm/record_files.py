"""Token ids as length-delimited binary records, with an offset index.

A record is the number of its bytes (uint64), that number's masked CRC-32C, the
document's ids (little-endian, the end id last) and their masked CRC-32C: the
framing of TFRecord files. Ids take two bytes each where the vocabulary allows,
else four. Documents are range-partitioned and sorted by
doc_id, one file for each range, so files in name order hold them in ascending
order. The index is a Parquet table (part, file, offset, size, width, doc_id,
n_tokens, first): where each record lies, the bytes of an id, and how many ids
precede it in its file. Reads in
any order need nothing else.

A task writes a file of its own name and hands its index rows to Spark; only
files that the committed index names count, so repeated or lost tasks leave
nothing that is read. Files are written and read through pyarrow's file systems
(local or mounted paths, hdfs, s3, gs), a batch of documents at a time.

Defined cases: NULL text is empty, a record of the end id alone. NULL doc_ids
come first; rows with equal doc_id are ordered by text. An empty table makes no
files and an empty index. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderboard.llm.crc32c import crc32c, masked
from orderboard.llm.tokens import ID_TYPE, default_vocabulary, encoder

END_ID = 0
BYTES_PER_FILE = 32 << 20
READ_RUN = 8 << 20
HEADER, FOOTER = 12, 4

INDEX = "part int, file string, offset long, size long, width int, doc_id long, n_tokens long, first long"
READ = "part int, first long, doc_id long, n_tokens long, ids binary"


class CorruptRecord(ValueError):
    """A record whose lengths or checksums do not agree."""


def frames(payloads: list[bytes]) -> list[bytes]:
    sizes = [np.uint64(len(p)).tobytes() for p in payloads]
    size_sums = masked(crc32c(sizes)).astype("<u4")
    sums = masked(crc32c(payloads)).astype("<u4")
    return [
        size + a.tobytes() + payload + b.tobytes()
        for size, a, payload, b in zip(sizes, size_sums, payloads, sums, strict=True)
    ]


def payloads(records: list[bytes]) -> list[bytes]:
    """The contents of whole records, each checked."""
    out = [r[HEADER:-FOOTER] for r in records]
    if frames(out) != records:
        bad = next(i for i, (p, r) in enumerate(zip(out, records, strict=True)) if frames([p])[0] != r)
        raise CorruptRecord(f"record {bad} of {len(records)}: length or checksum differs")
    return out


def id_width(vocabulary: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(vocabulary).get_vocab().values()
    return 2 if max(end_id, *ids) < 1 << 16 else 4


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return pafs.FileSystem.from_uri(folder)


def write_records(
    docs: DataFrame,
    folder: str,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    bytes_per_file: int = BYTES_PER_FILE,
) -> None:
    """Write ``folder/data`` and ``folder/index``."""
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], ID_TYPE).tobytes()
    width = id_width(path, end_id)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // bytes_per_file))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, out = TaskContext.get().partitionId(), None, None
        offset = first = 0
        encode = encoder(path).encode
        try:
            for batch in batches:
                if out is None:
                    system, place = _open(f"{folder}/data")
                    system.create_dir(place, recursive=True)
                    file = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
                    out = system.open_output_stream(f"{place}/{file}")
                ids = [encode(t.as_py() or "") + end for t in batch.column("text")]
                framed = frames([np.frombuffer(x, ID_TYPE).astype(f"<u{width}").tobytes() for x in ids])
                out.write(b"".join(framed))
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                sizes = np.array([len(x) for x in framed], np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array([file] * n, pa.string()),
                        pa.array(offset + np.cumsum(sizes) - sizes),
                        pa.array(sizes),
                        pa.array(np.full(n, width, np.int32)),
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array(counts),
                        pa.array(first + np.cumsum(counts) - counts),
                    ],
                    names=["part", "file", "offset", "size", "width", "doc_id", "n_tokens", "first"],
                )
                offset += int(sizes.sum())
                first += int(counts.sum())
        finally:
            if out is not None:
                out.close()

    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(files, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of the index name, in the rows' order and partitions.

    Neighbours in a file are read at once, up to ``READ_RUN`` bytes. Every record
    is checked; a wrong one fails the job as ``CorruptRecord``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _open(f"{folder}/data")
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                begin, until, size = at, rows[at]["offset"], 0
                while (
                    at < len(rows)
                    and rows[at]["file"] == rows[begin]["file"]
                    and rows[at]["offset"] == until
                    and (size == 0 or size + rows[at]["size"] <= READ_RUN)
                ):
                    until += rows[at]["size"]
                    size += rows[at]["size"]
                    at += 1
                run = rows[begin:at]
                if run[0]["file"] != name:
                    name = run[0]["file"]
                    source = system.open_input_file(f"{place}/{name}")
                data = source.read_at(size, run[0]["offset"])
                base = run[0]["offset"]
                found = payloads([data[r["offset"] - base : r["offset"] - base + r["size"]] for r in run])
                ids = [
                    np.frombuffer(x, f"<u{r['width']}").astype(ID_TYPE).tobytes()
                    for x, r in zip(found, run, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["part"] for r in run], pa.int32()),
                        pa.array([r["first"] for r in run], pa.int64()),
                        pa.array([r["doc_id"] for r in run], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["part", "first", "doc_id", "n_tokens", "ids"],
                )

    return index.mapInArrow(read, READ)


def in_file_order(index: DataFrame) -> DataFrame:
    """The whole index, dealt so that a task reads records that lie together."""
    return index.repartitionByRange("part", "offset").sortWithinPartitions("part", "offset")


def file_starts(index: DataFrame) -> DataFrame:
    """(part, before): the ids in all files before each one. One row for each file
    meets in a window; records do not."""
    per_file = index.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    upto = F.sum("held").over(Window.orderBy("part"))
    return per_file.select(F.col("part").alias("of_part"), (upto - F.col("held")).alias("before"))
