"""Pack documents into training sequences of a fixed number of tokens.

Documents are dealt into groups by a seeded hash; each group is packed on its
own, so groups are the unit of parallel work and of recovery, and a rerun packs
alike. In a group, a document's whole multiples of the sequence length fill
sequences by themselves; the rests are placed first-fit decreasing: a tournament
tree over the free space of the sequences finds the first that holds a rest in
logarithmic time. Last, the emptiest sequences are taken apart and their pieces
cut to fill the gaps of the others, as long as a gap has ``MIN_CUT`` tokens.

Only texts are shuffled. Groups are sized by documents and by bytes, so a group
fits in a worker however long the documents are; one document is the least.

Defined cases: NULL text is empty and an empty document is its end id alone.
Rows that repeat are packed as often as they occur; more equal rows than a group
has documents are spread over all groups. Any doc_id, NULL too, is
carried as it is. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.llm.tables import stored
from orderboard.llm.tokens import ID_TYPE, default_vocabulary, encoder

LENGTH = 2048
END_ID = 1
MIN_CUT = 16
DOCS_PER_GROUP = 2048
BYTES_PER_GROUP = 16 << 20
SEED = 20240607
COPIES = 4096

Piece = tuple[int, int, int]  # document, first id, number of ids
SCHEMA = (
    "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
)


class FreeSpace:
    """A tournament tree over sequences: each node has the most free space below it."""

    def __init__(self, sequences: int, length: int) -> None:
        self._width = 1 << max(0, (sequences - 1).bit_length())
        self._most = [length] * (2 * self._width)

    def take(self, size: int) -> int:
        """The first sequence with room for ``size``; its space is taken."""
        most, node = self._most, 1
        while node < self._width:
            node *= 2
            if most[node] < size:
                node += 1
        found = node - self._width
        most[node] -= size
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return found


def first_fit_decreasing(rests: list[Piece], length: int) -> list[list[Piece]]:
    space, sequences = FreeSpace(max(1, len(rests)), length), []
    for piece in sorted(rests, key=lambda p: (-p[2], p[0])):
        at = space.take(piece[2])
        if at == len(sequences):
            sequences.append([])
        sequences[at].append(piece)
    return sequences


def close_gaps(sequences: list[list[Piece]], length: int, min_cut: int) -> list[list[Piece]]:
    """Take the emptiest sequences apart to fill the gaps of the fuller ones."""
    filled = [(sum(p[2] for p in s), i) for i, s in enumerate(sequences)]
    order = [i for _, i in sorted(filled, key=lambda x: (-x[0], x[1]))]
    gap = {i: length - n for n, i in filled}
    receivers = [i for i in reversed(order) if gap[i] >= min_cut]  # widest gaps first
    first = 0
    while first < len(receivers):
        donor = receivers[first]
        others = [i for i in receivers[first + 1 :] if gap[i] >= min_cut]
        if sum(gap[i] for i in others) < length - gap[donor]:
            break
        for doc, start, size in sequences[donor]:
            while size:
                to = next(i for i in others if gap[i])
                part = min(size, gap[to])
                sequences[to].append((doc, start, part))
                gap[to] -= part
                start, size = start + part, size - part
        sequences[donor] = []
        first += 1
    return [s for s in sequences if s]


def pack_lengths(lengths: list[int], length: int = LENGTH, min_cut: int = MIN_CUT) -> list[list[Piece]]:
    """Sequences of pieces that hold every id of documents of these lengths once."""
    whole, rests = [], []
    for doc, n in enumerate(lengths):
        full = n // length
        whole += [[(doc, k * length, length)] for k in range(full)]
        if n % length:
            rests.append((doc, full * length, n % length))
    return whole + close_gaps(first_fit_decreasing(rests, length), length, min_cut)


def _groups(docs: DataFrame, docs_per_group: int, bytes_per_group: int) -> int:
    size = docs.select(
        F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    return max(1, -(-size["docs"] // docs_per_group), -(-(size["bytes"] or 0) // bytes_per_group))


def _dealt(docs: DataFrame, groups: int, docs_per_group: int, seed: int) -> DataFrame:
    """(doc_id, text, pack_group) by a seeded hash of both; rows that equal more than
    ``docs_per_group`` others are dealt in turn to all groups, beginning at their hash.

    Equal rows are interchangeable, so a rerun deals alike whichever copy comes first.
    """
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    keyed = docs.select("doc_id", "text", mark.alias("mark"))
    often = keyed.groupBy("mark").count().filter(F.col("count") > docs_per_group).select("mark")
    group = F.pmod(F.col("mark"), F.lit(groups)).alias("pack_group")
    often = stored(often, "packing-repeated")
    if often.isEmpty():
        return keyed.select("doc_id", "text", group)
    equal = keyed.join(often, "mark", "left_semi").groupBy("mark", "doc_id", "text").count()
    # Two steps and an exchange between them, so that no task makes more than COPIES rows
    # of one text in a row and no array is longer.
    begun = equal.withColumn("begin", F.explode(F.expr(f"sequence(0L, count - 1, {COPIES}L)")))
    spread = begun.repartition(groups, "mark", "begin").withColumn(
        "nth", F.explode(F.expr(f"sequence(begin, least(begin + {COPIES - 1}, count - 1))"))
    )
    turn = F.pmod(F.pmod(F.col("mark"), F.lit(groups)) + F.col("nth"), F.lit(groups)).alias("pack_group")
    return keyed.join(often, "mark", "left_anti").select("doc_id", "text", group).union(
        spread.select("doc_id", "text", turn)
    )


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = LENGTH,
    end_id: int = END_ID,
    min_cut: int = MIN_CUT,
    docs_per_group: int = DOCS_PER_GROUP,
    bytes_per_group: int = BYTES_PER_GROUP,
    seed: int = SEED,
) -> DataFrame:
    """One row for each piece, with its ids; see ``SCHEMA``.

    ``sequence_id`` and ``offset`` say where the piece lies; pieces of a sequence
    adjoin from offset 0.
    """
    path = vocabulary or default_vocabulary()
    groups = _groups(docs, docs_per_group, bytes_per_group)
    end = np.array([end_id], ID_TYPE).tobytes()

    def pack_group(key: tuple, rows: pa.Table) -> pa.Table:
        encode, group = encoder(path).encode, key[0].as_py()
        doc_ids = rows.column("doc_id").to_pylist()
        ids = [encode(t.as_py() or "") + end for t in rows.column("text")]
        out: dict[str, list] = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        packed = pack_lengths([len(x) // 4 for x in ids], length, min_cut)
        for number, sequence in enumerate(packed):
            offset = 0
            for doc, start, size in sequence:
                row = (
                    doc_ids[doc], start, size, len(ids[doc]) // 4, (group << 32) + number, offset,
                    ids[doc][4 * start : 4 * (start + size)],
                )
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                offset += size
        return pa.table(out, ARROW_SCHEMA)

    return _dealt(docs, groups, docs_per_group, seed).groupBy("pack_group").applyInArrow(pack_group, SCHEMA)


ARROW_SCHEMA = pa.schema(
    [(n, pa.binary() if n == "ids" else pa.int64()) for n in (c.split()[0] for c in SCHEMA.split(", "))]
)


def padding(lengths: Iterator[int], length: int = LENGTH) -> int:
    """Pad tokens of sequences with these numbers of ids; a power of two needs none."""
    return sum(length - n for n in lengths if n & (n - 1))
