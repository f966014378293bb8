"""Drop lines that many documents repeat, found by two Bloom filters.

One filter holds the lines seen once, the other those seen in a second document.
Tasks fill both for their documents and send only bit positions; positions meet
by segment of the filter, where a bit that two tasks set once is a repeat. A
line whose bits are all in the second filter is a suspect: every repeated line is
one, and few others. Only suspects are shuffled as text. They are counted exactly
by their whole text, and lines found in ``min_docs`` documents stay only in the
largest doc_id that holds them.

The filter's size follows the number of lines up to ``max_bits`` (32 MB by
default), so what is broadcast is bounded. A fuller filter lets more suspects
pass; the result is the same.

Common lines are counted within tasks before they are shuffled, and suspects and
confirmed lines meet as stored tables, so a hot line's join can be split.

Defined cases: NULL or empty text is one empty line. A document is a row: rows
that repeat count as several. A row whose doc_id is NULL keeps a repeated line
only if no row with an id holds it. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderboard.llm import bit_filter
from orderboard.llm.tables import stored, whole_row

MIN_DOCS = 3
MIN_CHARS = 20
BITS_PER_LINE = 8
HASHES = 2

_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: str) -> str:
    """Stripped of ASCII space, A-Z in lower case."""
    line = line.strip(_SPACE)
    return line.lower() if line.isascii() else line.encode().lower().decode()


def keys_of(text: str, min_chars: int = MIN_CHARS) -> dict[str, None]:
    """The distinct keys of a text that are long enough, in order."""
    return dict.fromkeys(k for k in map(line_key, text.split("\n")) if len(k) >= min_chars)


def positions(keys: Iterable[str], bits: int) -> np.ndarray:
    """A row of ``HASHES`` bit positions for each key."""
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(k.encode()) for k in keys), np.uint64)
    mask = np.uint64(bits - 1)
    return np.stack([(hashed >> np.uint64(32 * i)) & mask for i in range(HASHES)], axis=1).astype(np.int64)


def filter_bits(docs: DataFrame, max_bits: int) -> int:
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    lines = docs.select(F.sum(F.coalesce(newlines, F.lit(0)) + 1)).first()[0] or 0
    return bit_filter.size_for(lines, BITS_PER_LINE, max_bits)


def repeated_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The filter of lines seen in two documents, as packed bits."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_doc = [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                if keys := keys_of(text or "", min_chars):
                    per_doc.append(np.unique(positions(keys, bits)))
            yield bit_filter.sent(np.concatenate(per_doc), bits)

    return bit_filter.repeats(docs.select("text").mapInArrow(fill, bit_filter.SENT), bits)


def suspects(docs: DataFrame, repeated: np.ndarray, min_chars: int) -> DataFrame:
    """(doc_id, digest, key) of every line that the filter calls repeated, once a document."""
    bits = len(repeated) * 8
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            keys = [list(keys_of(t, min_chars)) if t else [] for t in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            flat = [k for ks in keys for k in ks]
            hit = np.flatnonzero(bit_filter.holds(seen, positions(flat, bits)).all(axis=1))
            rows = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("digest").take(rows),
                    pa.array([flat[i] for i in hit], pa.string()),
                ],
                names=["doc_id", "digest", "key"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "digest", "text").mapInArrow(test, f"doc_id {kind}, digest long, key string")


def without_lines(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    """What is left of each text without the lines of these keys."""
    out = []
    for text, keys in zip(texts, dropped, strict=True):
        lines = (text or "").split("\n")
        gone = set() if keys is None else set(keys)
        left = [x for x in lines if line_key(x) not in gone] if gone else lines
        out.append((len(lines), len(lines) - len(left), "\n".join(left)))
    return pd.DataFrame(out, columns=["n_lines", "n_dropped", "text"])


def drop_repeated_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    max_bits: int = bit_filter.MAX_BITS,
) -> DataFrame:
    """``row`` (the document's columns) and what is left: n_lines, n_dropped, text."""
    digest: Column = F.xxhash64("text")
    keyed = docs.select("doc_id", "text", digest.alias("digest"))
    repeated = repeated_filter(docs, filter_bits(docs, max_bits), min_chars)
    suspected = stored(suspects(keyed, repeated, min_chars), "line-suspects")
    confirmed = stored(
        suspected.groupBy("key")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        .filter(F.col("docs") >= min_docs)
        .select("key", "last"),
        "line-repeats",
    )
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("last"))
    drops = stored(
        suspected.join(confirmed, "key")
        .filter(elsewhere)
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("digest").alias("drop_digest"))
        .agg(F.collect_set("key").alias("dropped")),
        "line-drops",
    )
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))
    matched = rows.join(
        drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("digest") == F.col("drop_digest")), "left"
    )
    rest = F.pandas_udf(without_lines, "n_lines long, n_dropped long, text string")
    left = matched.select("row", rest(F.col("row.text"), F.col("dropped")).alias("left"))
    return left.select("row", "left.n_lines", "left.n_dropped", "left.text")
