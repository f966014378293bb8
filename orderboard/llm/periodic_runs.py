"""Runs of periodically repeated words, by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal), at
least ``min_length`` words and ``MIN_EXPONENT`` periods long, that no neighbouring
word extends. A text is cut into dyadic blocks: for each power of two L, blocks of
L words from the start on. A run whose period lies in [L, 2L) holds a whole block
that occurs again q words later, so each block asks where it occurs in the
neighbouring window of L starts. The suffix array holds a block's occurrences in one
interval, and a wavelet tree over it answers with range successors. Occurrences in
so short a window form an arithmetic progression: one or two of them are candidate
periods themselves; of more, only the shift that lines up the ends, or the starts,
of the two periodic stretches around block and progression can be one. Each
candidate is extended to both sides by the names of dyadic factors and kept if it
is long enough.

All of it is exact. The work is n log n for n words of a text; memory is about
4 (2 log n + 12) bytes a word for ``CHUNK_WORDS`` words, or for one longer text.
Rows are not shuffled: a lost executor repeats its own tasks only.

Defined cases: NULL or empty text has no words, no runs and an empty ``collapsed``.
Repeated rows get equal results, NULL ids are kept, extra columns are carried along
in ``row``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orderboard.llm.tables import whole_row

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Words that are worked on at once; a longer text is worked on alone.
CHUNK_WORDS = 200_000

RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


class RangeSuccessor:
    """A wavelet tree over an array of numbers below ``limit``, one level a bit.

    ``zeros[level][i]`` counts the numbers among the first i of that level that go
    to the level's left part. All queries take arrays and are answered at once.
    """

    def __init__(self, values: np.ndarray, limit: int) -> None:
        self.bits = max(1, int(limit - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            right = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~right, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~right], values[right]])

    def smaller(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many numbers of [low, high) are below ``than``."""
        count, whole = np.zeros(len(low), np.int64), high - low
        above = than >> self.bits > 0
        for level, before in enumerate(self.zeros):
            left_low, left_high = before[low], before[high]
            right = (than >> (self.bits - 1 - level)) & 1 == 1
            count += np.where(right, left_high - left_low, 0)
            low = np.where(right, before[-1] + low - left_low, left_low)
            high = np.where(right, before[-1] + high - left_high, left_high)
        return np.where(above, whole, count)

    def smallest(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number with ``place`` smaller ones in [low, high)."""
        value = np.zeros(len(low), np.int64)
        for before in self.zeros:
            left_low, left_high = before[low], before[high]
            inside = left_high - left_low
            right = place >= inside
            value = 2 * value + right
            place = np.where(right, place - inside, place)
            low = np.where(right, before[-1] + low - left_low, left_low)
            high = np.where(right, before[-1] + high - left_high, left_high)
        return value


class Blocks(NamedTuple):
    """Dyadic blocks: first word, words, and their interval of the suffix array."""

    at: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Texts:
    """The words of several texts in a row, as numbers that no two texts share.

    ``begin`` and ``end`` tell for each word where its text begins and ends.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        ends = np.cumsum(lengths)
        self.begin, self.end = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
        self.longest = int(lengths.max(initial=0))
        if len(ids):
            self._refine(ids)

    def _refine(self, ids: np.ndarray) -> None:
        """Sort suffixes by their first 1, 2, 4, ... words, as far as blocks go.

        A factor's name is the place of its first suffix in the suffix array, so
        equal names are equal factors and a name is the start of an interval. Only
        suffixes that are still tied are sorted again.
        """
        n = len(ids)
        self.order = np.argsort(ids, kind="stable")
        name, tied = np.zeros(n, np.int64), np.ones(n, np.int64)
        slots, key = np.arange(n), ids[self.order]
        self.names: list[np.ndarray] = []
        asked: list[Blocks] = []
        size = 1
        while True:
            at = self.order[slots]
            heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.diff(np.r_[heads, len(key)])
            name[at] = np.repeat(slots[heads], counts)
            tied[slots[heads]] = counts
            self.names.append(name.astype(np.int32))
            many = np.repeat(counts, counts)
            local = at - self.begin[at]
            held = (many >= MIN_EXPONENT - 1) & (local % size == 0) & (at + 2 * size <= self.end[at])
            block = at[held]
            asked.append(Blocks(block, np.full(len(block), size), name[block], name[block] + tied[name[block]]))
            slots = slots[many > 1]
            if not len(slots) or 2 * size * MIN_EXPONENT > self.longest:
                break
            at = self.order[slots]
            follows = at + size
            second = np.where(follows < self.end[at], name[np.minimum(follows, n - 1)], -1)
            key = name[at] * (n + 1) + second + 1
            sort = np.argsort(key)
            key = key[sort]
            self.order[slots] = at[sort]
            size *= 2
        self.blocks = Blocks(*map(np.concatenate, zip(*asked, strict=True)))

    def _equal(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from a and b on, or before them for a negative step."""
        agreed = np.zeros(len(a), np.int64)
        begin, end, last = self.begin[a], self.end[a], len(self.begin) - 1
        for level in range(len(self.names) - 1, -1, -1):
            size, name = 1 << level, self.names[level]
            again = np.arange(len(a))
            while len(again):
                shift = agreed[again] if step > 0 else -agreed[again] - size
                x, y = a[again] + shift, b[again] + shift
                inside = (x >= begin[again]) & (y + size <= end[again])
                same = inside & (name[np.clip(x, 0, last)] == name[np.clip(y, 0, last)])
                again = again[same]
                agreed[again] += size
                if level < len(self.names) - 1:
                    break
        return agreed

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._equal(a, b, 1)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._equal(a, b, -1)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """(first words of blocks, periods) among which those of all runs are."""
        found = RangeSuccessor(self.order - self.begin[self.order], self.longest)
        block = self.blocks
        local = block.at - self.begin[block.at]
        first = found.smaller(block.low, block.high, local + block.size)
        times = found.smaller(block.low, block.high, local + 2 * block.size) - first
        hit = np.flatnonzero(times)
        block, first, times = Blocks(*(x[hit] for x in block)), first[hit], times[hit]
        text = self.begin[block.at]
        one = found.smallest(block.low, block.high, first) + text
        more = np.flatnonzero(times > 1)
        two = found.smallest(block.low[more], block.high[more], first[more] + 1) + text[more]

        single, pair = times < 3, times[more] == 2
        long = more[~pair]
        p, s, d = block.at[long], one[long], (two - one[more])[~pair]
        by_end = s + self.ahead(s, s + d) - p - self.ahead(p, p + d)
        by_start = s - self.behind(s, s + d) - p + self.behind(p, p + d)
        at = np.concatenate([block.at[single], block.at[more][pair], p, p])
        period = np.concatenate([(one - block.at)[single], (two - block.at[more])[pair], by_end, by_start])
        size = np.concatenate([block.size[single], block.size[more][pair], block.size[long], block.size[long]])
        fits = (period >= size) & (period < 2 * size) & (at + period < self.end[at])
        return at[fits], period[fits]

    def runs(self, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, ends, periods) of all runs, by first word and period."""
        if not len(self.begin):
            return (np.zeros(0, np.int64),) * 3
        at, period = self.candidates()
        start = at - self.behind(at, at + period)
        stop = at + period + self.ahead(at, at + period)
        enough = stop - start >= np.maximum(min_length, MIN_EXPONENT * period)
        start, stop, period = start[enough], stop[enough], period[enough]
        # Multiples of a period span the same stretch; the smallest is the run's.
        order = np.lexsort((period, stop, start))
        start, stop, period = start[order], stop[order], period[order]
        new = np.r_[True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])][: len(start)]
        start, stop, period = start[new], stop[new], period[new]
        order = np.lexsort((period, start))
        return start[order], stop[order], period[order]


class _Numbers(dict):
    """Numbers for words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> tuple[pa.Array, list[bytes]]:
    """The runs of each text, given by its words, and the words left of it.

    A run keeps its first period; its other words go.
    """
    lengths = np.array([len(words) for words in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    ids = np.concatenate(
        [np.zeros(0, np.int64)]
        + [
            np.fromiter(map(_Numbers().__getitem__, words), np.int64, len(words)) + begin
            for words, begin in zip(texts, begins, strict=True)
        ]
    )
    start, stop, period = Texts(ids, lengths).runs(min_length)
    of = np.searchsorted(begins + lengths, start, side="right")
    offsets = np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))].astype(np.int32)
    fields = [start - begins[of], stop - start, period]
    found = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], ["start", "length", "period"])

    covered = np.zeros(len(ids) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, stop, -1)
    kept = np.cumsum(covered[:-1]) == 0
    touched = set(of.tolist())
    left = [
        b" ".join(compress(words, kept[begin : begin + len(words)].tolist()) if i in touched else words)
        for i, (words, begin) in enumerate(zip(texts, begins, strict=True))
    ]
    return pa.ListArray.from_arrays(pa.array(offsets), found), left


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``row`` (the document's columns), its ``runs`` by start and period, counted in
    words from 0, and ``collapsed``: the text's words, one space apart, without
    those that a run holds after its first period."""
    rows = docs.select(whole_row(docs).alias("row"))
    schema = T.StructType([*rows.schema.fields, T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            texts = row.field("text").cast(pa.binary())
            begin, words, held = 0, [], 0
            for i in range(len(texts)):
                words.append((texts[i].as_py() or b"").split())
                held += len(words[-1])
                if held >= CHUNK_WORDS or i == len(texts) - 1:
                    runs, left = runs_of(words, min_length)
                    yield pa.RecordBatch.from_arrays(
                        [row.slice(begin, len(words)), runs, pa.array(left, pa.binary()).cast(pa.string())],
                        names=["row", "runs", "collapsed"],
                    )
                    begin, words, held = i + 1, [], 0

    return rows.mapInArrow(find, schema)
