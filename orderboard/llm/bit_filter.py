"""Two bit filters over the whole input: positions seen once, and seen again.

Tasks send the distinct positions of their rows by segment of the filter; where
segments meet, a position that two tasks sent, or one task saw twice, is a
repeat. The bits of repeats, of bounded size, come to the driver as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_BITS = 1 << 16
MAX_BITS = 1 << 28
SEGMENT = 1 << 20
SENT = "segment long, once binary, twice binary"


def size_for(entries: float, bits_each: int, max_bits: int = MAX_BITS) -> int:
    """A power of two near ``bits_each`` bits for each entry, within bounds."""
    return min(max_bits, max(MIN_BITS, 1 << int(entries * bits_each).bit_length()))


def sent(positions: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows ``SENT`` for the positions of one batch, repeats among them included."""
    segment = min(SEGMENT, bits)
    at, times = np.unique(positions, return_counts=True)
    of = (at // segment).astype(np.int64)
    ends = np.flatnonzero(np.r_[of[1:] != of[:-1], True][: len(of)]) + 1
    starts = np.r_[0, ends][: len(ends)]
    inside = (at % segment).astype("<u4")
    ranges = list(zip(starts, ends, strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(of[starts], pa.int64()),
            pa.array([inside[a:b].tobytes() for a, b in ranges], pa.binary()),
            pa.array([inside[a:b][times[a:b] > 1].tobytes() for a, b in ranges], pa.binary()),
        ],
        names=["segment", "once", "twice"],
    )


def repeats(rows: DataFrame, bits: int) -> np.ndarray:
    """The packed bits of positions that occur twice in rows ``SENT``."""
    segment = min(SEGMENT, bits)

    def packed(number: int, seen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())],
            names=["segment", "bits"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, np.zeros(segment, np.uint8)
        for batch in batches:
            for number, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != now:
                    if now is not None:
                        yield packed(now, seen)
                    now, seen = number, np.zeros(segment, np.uint8)
                p = np.frombuffer(once, "<u4")
                seen[p] = np.minimum(seen[p] + 1, 2)
                seen[np.frombuffer(twice, "<u4")] = 2
        if now is not None:
            yield packed(now, seen)

    met = rows.repartition("segment").sortWithinPartitions("segment")
    whole = np.zeros(bits // 8, np.uint8)
    for row in met.mapInArrow(merge, "segment long, bits binary").collect():  # bits / 8 bytes in all
        begin = row["segment"] * segment // 8
        whole[begin : begin + segment // 8] = np.frombuffer(row["bits"], np.uint8)
    return whole


def holds(filter_: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Whether each position's bit is set."""
    return ((filter_[positions >> 3] >> (7 - (positions & 7))) & 1).astype(bool)
