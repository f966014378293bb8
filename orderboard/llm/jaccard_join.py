"""Exact Jaccard join of documents on word shingles, by regions, pivots and windows.

Distances between sets of shingles are a metric, and so is the number of
shingles in which two sets differ. Documents link when 100 times the
intersection is at least ``percent`` times the union; sets of a and b shingles
then differ in at most ``(a + b) (100 - percent) / (100 + percent)``.

1. *Nodes.* Documents with the same set are one node.
2. *Regions.* Whole-set pivots would leave nearly every document at distance 1
   from all of them, and the triangle inequality would copy it to every region.
   So the shingles are cut by hash into one part more than linked sets may
   differ in, and pivots are taken part by part: in some part linked sets agree,
   at distance 0 from the same pivot. A node is copied to the region of each of
   its parts, for its own class of sizes and the class of smaller partners. Empty
   parts tell nothing; a node with too many of them, or a small one, is copied
   to the regions of its first shingles in hash order instead, one more than may
   differ, which linked sets share as well.
3. *Pivots.* Regions of one node vanish: names of regions and nodes, 16 bytes a
   pair, are shuffled once, packed by segment, and only pairs of shared regions
   come back. In every other region the smallest node is the pivot, and all its
   nodes are compared with it: those that sizes and sketches allow to link, exactly.
   Nodes that link are one component, which settles a large group of near copies
   without pairs among them.
4. *Windows.* Regions that still hold several components are joined within:
   nodes go to their nearest pivot's cell, and to each cell that the triangle
   inequality cannot rule out; cells are joined recursively, the small ones pair
   by pair. This goes twice. First each block of a region gives only the nearest
   pairs that would make one component of its nodes, fewer than it has nodes; they
   are compared exactly. Regions of which pairs were left out go again with the
   components as they are then, and give all pairs that still part components.

Distances of parity sketches never exceed the sets' own, so nothing that links is
lost by them. A sketch has at least as many bits as its set has shingles (1024 at
least, ``MOST_SKETCH_BITS`` at most), as a fuller one tells no set from another;
halves of a wider one fold to a narrower. Sketches, 128 bytes or more a node, are
made with the regions; the sets themselves, 8 bytes a shingle, only of nodes in
pairs that sketches allow.

``memberships`` and ``keep_one_each`` need components only and skip pairs that
are known to be of one. ``links`` and ``link_counts`` skip none: pivots give way
to windows over all pairs, and links are counted by distinct sets, weighted by
their documents.

Regions are cut into blocks, so a task holds at most two blocks; nodes of a region's
largest component meet only the others' blocks, so they are not copied to each other's.
Copies and near copies meet as stored tables, so a hot region's joins can be split.
Stored tables go as soon as what was made of them is stored.

Defined cases: NULL, empty and wordless texts have no shingle and link with
nothing; a text of fewer words than a shingle is one shingle. The component of
documents without any doc_id is NULL. Rows that repeat are members like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.llm.components import components
from orderboard.llm.tables import WORD, removed, stored
from orderboard.operators.key_filter import marked, may_match

SEGMENT_BYTES = 16 << 20
MIN_SEGMENTS = 256
# Pairs of keys and marks that are sorted at once before they are sent.
SENT_PAIRS = 1 << 18
# Pairs of keys and marks are exchanged in so many turns at most, each of so many bytes at least.
TURNS = 4
TURN_BYTES = 64 << 20
SKETCH_BITS = 1024
MOST_SKETCH_BITS = 1 << 16
BLOCK = 2000
LEAF = 256
# Pairs of sketches of ``SKETCH_BITS`` that are held at once.
COMPARED = 1 << 15
SMALL = 40
CLASS_WIDTH = 1.25
MAX_REMEMBERED = 50_000
# Texts whose sets a task holds at once.
TEXTS = 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MAX_REMEMBERED:
            self[word] = value
        return value


_WORDS = _WordHashes()


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    long = min(size, len(words))
    total = np.full(len(words) - long + 1, long, np.uint64)
    for i in range(long):
        total = mixed(total + hashed[i : len(words) - long + 1 + i]) * _ODD
    return np.unique(total)


def node_of(found: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return mixed(found).sum(dtype=np.uint64).tobytes() + mixed(found ^ _ODD).sum(dtype=np.uint64).tobytes()


def sketch_of(found: np.ndarray) -> bytes:
    """The parity of the shingles in each of as many cells, a power of two, as there are shingles.

    ``SKETCH_BITS`` cells at least and ``MOST_SKETCH_BITS`` at most.
    """
    bits = SKETCH_BITS
    while bits < min(len(found), MOST_SKETCH_BITS):
        bits *= 2
    cells = np.bincount((mixed(found + _ODD) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int | None = None) -> np.ndarray:
    """A row of 64-bit words for each sketch, of ``size`` bytes or those of the narrowest.

    Cells are remainders by powers of two, so the parts of a wider sketch add up, without
    carry, to the narrower sketch of the same set.
    """
    sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
    size = size or int(sizes.min(initial=MOST_SKETCH_BITS // 8))
    out = np.empty((len(sketches), size // 8), np.uint64)
    for wide in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == wide)
        parts = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64)
        out[at] = np.bitwise_xor.reduce(parts.reshape(len(at), wide // size, size // 8), axis=1)
    return out


@dataclass(frozen=True)
class Rule:
    """When sets link, and the regions that linked sets share."""

    size: int = 3
    percent: int = 90

    def differ(self, a, b):
        """The most shingles that linked sets of a and b shingles differ in."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def class_of(self, n: int) -> tuple[int, int]:
        """The smallest and largest size of n's class."""
        low = 1
        while True:
            following = max(low + 1, int(low * CLASS_WIDTH))
            if n < following:
                return low, following - 1
            low = following

    def parts(self, low: int, high: int) -> tuple[int, int]:
        """(parts, empty parts that are no risk) for pairs whose smaller set is of this class."""
        most = int(self.differ(high, high * 100 // self.percent))
        spare = 0
        for _ in range(20):
            empty = (most + 1 + spare) * exp(-low / (most + 1 + spare))
            spare = ceil(empty + 4 * sqrt(empty))
        return most + 1 + spare, spare

    def keys(self, found: np.ndarray) -> np.ndarray:
        """The 64-bit names of a set's regions."""
        n, out = len(found), []
        low, high = self.class_of(max(1, -(-n * self.percent // 100)))
        while low <= n:
            most = int(self.differ(high, high * 100 // self.percent))
            if most:
                tag = mixed(np.array([low * 2], np.uint64) * _ODD)
                count, spare = self.parts(low, high) if low >= SMALL else (0, -1)
                empty = 0
                if count:
                    part = (mixed(found ^ tag) % np.uint64(count)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    part = part[order]
                    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    sums = np.add.reduceat(mixed(found)[order], starts)
                    out.append(mixed(sums ^ mixed(part[starts].astype(np.uint64) * _ODD + tag)))
                    empty = count - len(starts)
                if empty > spare:
                    first = np.sort(mixed(found ^ (tag + np.uint64(1))))[: most + 1]
                    out.append(mixed(first + tag))
            low, high = high + 1, max(high + 1, int((high + 1) * CLASS_WIDTH) - 1)
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def link(self, one: np.ndarray, other: np.ndarray) -> bool:
        common = len(np.intersect1d(one, other, assume_unique=True))
        return 100 * common >= self.percent * (len(one) + len(other) - common) and common > 0


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, after which a worker gives back what Arrow keeps for later batches.

    Workers outlive their tasks, so what they keep adds to that of the next stages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return run


def _portions(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to ``most`` at most, or of one longer row."""
    ends, begin = np.cumsum(lengths, dtype=np.int64), 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield begin, end
        begin = end


def documents_with_keys(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, digest, n, node, mark, sketch, keys) of each document; ``mark`` shortens ``node``."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t, rule.size) for t in batch.column("text").to_pylist()]
            nodes = [node_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("digest"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(np.frombuffer(b"".join(n[:8] for n in nodes), np.int64)),
                    pa.array([sketch_of(s) for s in sets], pa.binary()),
                    _lists([rule.keys(s).view(np.int64) for s in sets], pa.int64()),
                ],
                names=["doc_id", "digest", "n", "node", "mark", "sketch", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    schema = f"doc_id {kind}, digest long, n long, node binary, mark long, sketch binary, keys array<long>"
    return stored(read.mapInArrow(_released(describe), schema), "jaccard-documents")


def _packed(segment: np.ndarray, keys: np.ndarray, marks: np.ndarray, sure: bool) -> pa.RecordBatch:
    """A row for each segment: its keys and marks as bytes."""
    order = np.argsort(segment, kind="stable")
    segment, keys, marks = segment[order], keys[order], marks[order]
    ends = np.flatnonzero(np.r_[segment[1:] != segment[:-1], True][: len(segment)]) + 1
    starts = np.r_[0, ends][: len(ends)]
    ranges = list(zip(starts, ends, strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(segment[starts], pa.int64()),
            pa.array([sure] * len(starts), pa.bool_()),
            pa.array([keys[a:b].tobytes() for a, b in ranges], pa.binary()),
            pa.array([marks[a:b].tobytes() for a, b in ranges], pa.binary()),
        ],
        names=["segment", "sure", "keys", "marks"],
    )


def _sorted_pairs(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, mark) in order; whether each is its key's first, its last."""
    order = np.lexsort((marks, keys))
    keys, marks = keys[order], marks[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])][: len(keys)]
    keys, marks = keys[fresh], marks[fresh]
    change = keys[1:] != keys[:-1]
    return keys, marks, np.r_[True, change][: len(keys)], np.r_[change, True][: len(keys)]


def sent_pairs(
    batches: Iterator[pa.RecordBatch], segments: int, most: int = SENT_PAIRS
) -> Iterator[pa.RecordBatch]:
    """The packed pairs of (mark, keys) rows, sorted ``most`` at a time."""
    for batch in batches:
        lengths = np.diff(batch.column("keys").offsets.to_numpy())
        for begin, end in _portions(lengths, most):
            part = batch.slice(begin, end - begin)
            keys, marks, first, last = _sorted_pairs(
                part.column("keys").flatten().to_numpy(),
                np.repeat(part.column("mark").to_numpy(), lengths[begin:end]),
            )
            for chosen, by, sure in ((first | last, keys, False), (~(first | last), marks, True)):
                at = (mixed(by[chosen].view(np.uint64)) % np.uint64(segments)).astype(np.int64)
                yield _packed(at, keys[chosen], marks[chosen], sure)


def keys_of_turn(batch: pa.RecordBatch, turn: int, turns: int) -> pa.RecordBatch:
    """The (mark, keys) rows with only the keys of one turn."""
    lists = batch.column("keys")
    keys, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    chosen = keys.view(np.uint64) % np.uint64(turns) == turn
    held = np.r_[0, np.cumsum(chosen)][ends - ends[:1]].astype(np.int32)
    kept = pa.ListArray.from_arrays(pa.array(held), pa.array(keys[chosen], pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column("mark"), kept], names=["mark", "keys"])


def shared_in_turns(
    described: DataFrame, segment_bytes: int = SEGMENT_BYTES, turn_bytes: int = TURN_BYTES
) -> list[DataFrame]:
    """``shared_pairs`` of the keys of each turn, each stored.

    A turn's exchange is removed before the next one begins, so the pairs of all
    keys, the largest exchange of the join, never lie on disk together.
    """
    pairs = described.select(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    turns = max(1, min(TURNS, 16 * pairs // turn_bytes))
    segments = max(MIN_SEGMENTS, -(-16 * pairs // turns // segment_bytes))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def found(keys: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
            key, mark, first, last = _sorted_pairs(np.concatenate(keys), np.concatenate(marks))
            several = ~(first & last)
            return pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(mark[several])], names=["key", "mark"])

        for batch in batches:
            # Packed rows are large: they are read where they lie, not copied together.
            for segment, sure, *packed in zip(*batch.columns, strict=True):
                segment, sure = segment.as_py(), sure.as_py()
                pair = tuple(np.frombuffer(memoryview(p.as_buffer()), np.int64) for p in packed)
                if sure:
                    pair = tuple(map(np.copy, pair))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], names=["key", "mark"])
                    continue
                if segment != now and held[0]:
                    yield found(*held)
                    held = ([], [])
                now = segment
                for kept, values in zip(held, pair, strict=True):
                    kept.append(values)
        if held[0]:
            yield found(*held)

    def shared(turn: int) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return sent_pairs((keys_of_turn(batch, turn, turns) for batch in batches), segments)

        sent = described.select("mark", "keys").mapInArrow(
            _released(send), "segment long, sure boolean, keys binary, marks binary"
        )
        met = sent.repartition("segment").sortWithinPartitions("segment")
        return stored(met.mapInArrow(_released(settle), "key long, mark long"), "jaccard-shared")

    return [shared(turn) for turn in range(turns)]


def shared_pairs(
    described: DataFrame, segment_bytes: int = SEGMENT_BYTES, turn_bytes: int = TURN_BYTES
) -> DataFrame:
    """(key, mark) of the nodes of every region that holds two nodes or more.

    Each portion of documents, ``SENT_PAIRS`` pairs or one document, sends 16 bytes
    for a pair, in one row for each segment of the keys. Of a key that several nodes
    of a portion have, only the first and last mark meet those of other portions: two
    marks already make it shared, so the others are sure, and travel in segments of
    their own marks. A region of any size so brings at most two marks of each portion
    to its segment.
    """
    return reduce(DataFrame.unionByName, shared_in_turns(described, segment_bytes, turn_bytes))


def distinct_nodes(described: DataFrame) -> DataFrame:
    """(mark, node, n, sketch) of each node, once."""
    return stored(described.select("mark", "node", "n", "sketch").distinct(), "jaccard-nodes")


def regions(described: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, n) of every region that holds two nodes or more."""
    named = nodes.select(F.col("mark").alias("of"), "node", "n")
    shared = shared_in_turns(described)
    members = reduce(DataFrame.unionByName, shared).join(named, F.col("mark") == F.col("of"))
    found = stored(members.select("key", "node", "n").distinct(), "jaccard-members")
    removed(*shared)
    return found


def prepared(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest, n, node) of each document, ``distinct_nodes`` and ``regions``."""
    described = documents_with_keys(docs, rule)
    nodes = distinct_nodes(described)
    named = stored(described.select("doc_id", "digest", "n", "node"), "jaccard-named")
    members = regions(described, nodes)
    removed(described)
    return named, nodes, members


def possible(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) of nodes that sizes and sketches allow to link."""
    u, v = (
        nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        for c in "uv"
    )
    both = pairs.select("u", "v").join(u, "u").join(v, "v")

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
            near = 100 * np.minimum(a, b) >= rule.percent * np.maximum(a, b)
            one, other = (batch.column(c).to_pylist() for c in ("sketch_u", "sketch_v"))
            sizes = np.fromiter(map(min, map(len, one), map(len, other)), np.int64, len(one))
            for size in np.unique(sizes[near]).tolist():
                at = np.flatnonzero(near & (sizes == size))
                x, y = (folded([found[i] for i in at.tolist()], size) for found in (one, other))
                near[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= rule.differ(a[at], b[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v")], names=["u", "v"]
            ).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(_released(allow), "u binary, v binary")


def ends(pairs: DataFrame) -> DataFrame:
    """(node) of every node that a pair names, once."""
    return pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()


def node_sets(docs: DataFrame, named: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """(node, n, found) of the given nodes, from one document of each."""
    chosen = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")).alias("one")
    wanted = stored(
        named.join(nodes, "node", "left_semi").groupBy("node").agg(chosen)
        .select(F.col("one.doc_id").alias("id"), F.col("one.digest").alias("of")),
        "jaccard-wanted",
    )
    texts = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    # Most texts are in no pair; they stay out of the exchange.
    texts = may_match(texts, wanted.select(F.col("of").alias("digest")), "digest").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left_semi"
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles(t, rule.size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([node_of(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["node", "n", "found"],
            )

    found = texts.select("text").mapInArrow(_released(describe), "node binary, n long, found binary")
    sets = stored(found.dropDuplicates(["node"]), "jaccard-sets")
    removed(wanted)
    return sets


def linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (u, v) of nodes whose sets link, compared in full."""
    ids = pairs.select("u", "v")
    first = sets.select(F.col("node").alias("un"), F.col("found").alias("uf"))
    second = sets.select(F.col("node").alias("vn"), F.col("found").alias("vf"))
    both = ids.join(first, F.col("u") == F.col("un")).join(second, F.col("v") == F.col("vn"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("uf"), batch.column("vf")
            keep = [
                rule.link(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64))
                for a, b in zip(one, other, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v")], names=["u", "v"]
            ).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "uf", "vf").mapInArrow(_released(compare), "u binary, v binary")


def verified(docs: DataFrame, named: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """``linked`` of the pairs (u, v), stored; the sets are made for it and removed."""
    sets = node_sets(docs, named, ends(pairs), rule)
    near = stored(linked(pairs, sets, rule), "jaccard-links")
    removed(sets)
    return near


def _distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Hamming distances of packed sketches, a row for each of ``one``."""
    out = np.zeros((len(one), len(other)), np.int32)
    for word in range(one.shape[1]):
        out += np.bitwise_count(one[:, word, None] ^ other[None, :, word]).astype(np.int32)
    return out


def window_join(
    sketch: np.ndarray, n: np.ndarray, root: np.ndarray, rule: Rule, rows: np.ndarray, leaf: int = LEAF
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different roots that sketches and sizes allow to link.

    ``rows`` are dealt to the cells of their nearest pivots and to those within
    the window; where that does not shrink them, or they are few, all are compared.
    """
    if len(rows) > leaf:
        pivots = rows[:: max(1, len(rows) // max(2, int(sqrt(len(rows)) / 2)))]
        away = _distances(sketch[rows], sketch[pivots])
        home = away.min(axis=1)
        widest = int(rule.differ(n[rows].max(), n[rows].max()))
        cells = [rows[away[:, j] <= home + 2 * widest] for j in range(len(pivots))]
        if max(map(len, cells)) <= 0.8 * len(rows) and sum(map(len, cells)) <= 4 * len(rows):
            for cell in cells:
                yield from window_join(sketch, n, root, rule, cell, leaf)
            return
    step = max(1, COMPARED * SKETCH_BITS // (64 * sketch.shape[1]))
    for begin in range(0, len(rows), leaf):
        part, rest = rows[begin : begin + leaf], rows[begin:]
        a, b = n[part][:, None], n[rest][None, :]
        fits = (root[part][:, None] != root[rest][None, :]) & (
            100 * np.minimum(a, b) >= rule.percent * np.maximum(a, b)
        )
        i, j = np.nonzero(fits)
        if len(i):
            x, y = part[i], rest[j]
            for k in range(0, len(x), step):
                u, v = x[k : k + step], y[k : k + step]
                near = np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1) <= rule.differ(n[u], n[v])
                yield u[near], v[near]


def nearest_joining(
    found: Iterator[tuple[np.ndarray, np.ndarray]], sketch: np.ndarray, root: np.ndarray
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the pairs found, near ones that join all components that any of them joins.

    ``root`` is changed in place to the components that the pairs would make, so
    that ``window_join`` compares no more nodes that are joined already. Also
    whether pairs of different components were left out.
    """

    def inside(of: np.ndarray) -> int:
        held = np.unique(of, return_counts=True)[1].astype(np.int64)
        return int((held * (held - 1) // 2).sum())

    known, x, y = inside(root), [], []
    for u, v in found:
        nearest = np.argsort(np.bitwise_count(sketch[u] ^ sketch[v]).sum(axis=1), kind="stable")
        u, v = u[nearest], v[nearest]
        while True:
            apart = root[u] != root[v]
            u, v = u[apart], v[apart]
            if not len(u):
                break
            # The nearest pair of each component.
            firsts = [np.unique(root[side], return_index=True)[1] for side in (u, v)]
            for i in np.union1d(*firsts).tolist():
                one, other = root[u[i]], root[v[i]]
                if one != other:
                    root[root == other] = one
                    x.append(u[i])
                    y.append(v[i])
    return np.array(x, np.int64), np.array(y, np.int64), inside(root) - known > len(x)


def open_regions(members: DataFrame) -> DataFrame:
    """(region, held, largest, major) of regions with several roots: their nodes and the
    root that most of them have, with the number of these."""
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("same"))
    by_key = by_root.groupBy(F.col("key").alias("region")).agg(
        F.sum("same").alias("held"), F.max(F.struct("same", "root")).alias("most"), F.count(F.lit(1)).alias("roots")
    )
    return by_key.filter("roots > 1").select(
        "region", "held", F.col("most.same").alias("largest"), F.col("most.root").alias("major")
    )


def pairs_within(
    members: DataFrame, sizes: DataFrame, nodes: DataFrame, rule: Rule, joining: bool = False, block: int = BLOCK
) -> DataFrame:
    """(u, v, again) of nodes of a region and different roots that may link, u and v once.

    ``members`` has key, node, n and root, ``sizes`` the regions to join as
    ``open_regions`` has them. A region of many nodes is cut into blocks of about
    ``block``, those of its ``major`` root apart from the others, and each two blocks
    that may hold different roots meet in a task. ``joining`` asks for ``nearest_joining``
    pairs only; regions of which pairs were left out are then rows of their own, with
    their key in ``again``.
    """
    whole, is_major = F.col("held") <= block, F.col("root").eqNullSafe(F.col("major"))
    # Blocks of the major root's nodes come first, then those of the others.
    theirs = F.ceil(F.col("largest") / block).cast("int")
    blocks = theirs + F.ceil((F.col("held") - F.col("largest")) / block).cast("int")
    begin, end = F.when(is_major, 0).otherwise(theirs), F.when(is_major, theirs).otherwise(blocks)
    within = F.pmod(F.xxhash64("node"), F.greatest(end - begin, F.lit(1))).cast("int")
    others = F.sequence(F.when(is_major, theirs).otherwise(0), blocks - 1)
    dealt = (
        members.join(sizes, F.col("key") == F.col("region"))
        .withColumn("mine", F.when(whole, 0).otherwise(begin + within))
        .withColumn("other", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(others)))
        .select(
            "key",
            F.least("mine", "other").alias("low"),
            F.greatest("mine", "other").alias("high"),
            "node",
            "n",
            F.xxhash64("root").alias("root"),
        )
    )
    sketches = nodes.select(F.col("node").alias("of"), "sketch")

    def meet(rows: pa.Table) -> pa.Table:
        node = rows.column("node").combine_chunks()
        sketch = folded(rows.column("sketch").to_pylist())
        n, root = rows.column("n").to_numpy(), np.copy(rows.column("root").to_numpy())
        found, again = window_join(sketch, n, root, rule, np.arange(len(rows))), []
        if joining:
            x, y, left_out = nearest_joining(found, sketch, root)
            again = rows.column("key")[:1].to_pylist() if left_out else []
        else:
            parts = [(np.zeros(0, np.int64),) * 2, *found]
            x, y = (np.concatenate([part[i] for part in parts]) for i in (0, 1))
        return pa.table(
            {
                "u": pa.chunked_array([node.take(pa.array(x)), pa.nulls(len(again), node.type)]),
                "v": pa.chunked_array([node.take(pa.array(y)), pa.nulls(len(again), node.type)]),
                "again": pa.chunked_array([pa.nulls(len(x), pa.int64()), pa.array(again, pa.int64())]),
            }
        )

    held = dealt.join(sketches, F.col("node") == F.col("of")).select("key", "low", "high", "node", "n", "sketch", "root")
    met = held.groupBy("key", "low", "high").applyInArrow(meet, "u binary, v binary, again long")
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "again").distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, n, root) of the members, stored; a node without a root is its own."""
    found = members.select("key", "node", "n").join(roots, "node", "left")
    return stored(found.select("key", "node", "n", F.coalesce("root", "node").alias("root")), "jaccard-rooted")


def memberships(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Every document with its component: doc_id, digest, n_shingles, group, component_id.

    ``group`` names the component whatever its doc_ids; NULL for texts without words.
    """
    rule = rule or Rule()
    named, nodes, members = prepared(docs, rule)
    pivots = stored(members.groupBy("key").agg(F.min("node").alias("pivot")), "jaccard-pivots")
    starred = stored(members.join(pivots, "key").filter(F.col("node") != F.col("pivot")), "jaccard-starred")
    removed(members, pivots)
    stars = starred.select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    maybe = stored(possible(stars, nodes, rule), "jaccard-possible")
    near = verified(docs, named, maybe, rule)
    roots = components(near)
    rooted = _rooted(starred, roots)
    removed(maybe, near, starred)

    for joining in (True, False):
        sizes = stored(open_regions(rooted), "jaccard-open")
        found = stored(pairs_within(rooted, sizes, nodes, rule, joining), "jaccard-possible")
        near = verified(docs, named, found.filter("u IS NOT NULL").select("u", "v"), rule)
        if not near.isEmpty():
            last, roots = roots, components(near.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
            removed(last)
        again = found.filter("again IS NOT NULL").select(F.col("again").alias("key")).distinct()
        last, rooted = rooted, _rooted(rooted.join(again, "key", "left_semi"), roots)
        removed(last, found, near, sizes)
        if rooted.isEmpty():
            break
    removed(rooted, nodes)

    grouped = stored(
        named.join(roots, "node", "left").select(
            "doc_id", "digest", "n", F.when(F.col("n") > 0, F.coalesce("root", "node")).alias("group")
        ),
        "jaccard-grouped",
    )
    removed(named, roots)
    smallest = stored(
        grouped.filter(F.col("n") > 0).groupBy("group").agg(F.min("doc_id").alias("least")), "jaccard-least"
    )
    return grouped.join(smallest, "group", "left").select(
        "doc_id",
        "digest",
        F.col("n").alias("n_shingles"),
        "group",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def links(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Every two distinct sets that link, once: u, v, docs_u, docs_v.

    u < v are nodes and docs_u and docs_v their documents, so a row stands for
    ``docs_u * docs_v`` links of documents. Regions and windows are those of
    ``memberships``, without its pivots, which only settle components: nodes of
    a region that any window allows are compared. In a group of k sets that all
    link that is k (k - 1) / 2 rows, as many as there are links.
    """
    return _links(docs, rule or Rule())[1]


def _links(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n, node) of each document, and ``links``."""
    named, nodes, members = prepared(docs, rule)
    # Each node its own root: none of its pairs are settled.
    rooted = members.withColumn("root", F.col("node"))
    sizes = members.groupBy(F.col("key").alias("region")).agg(F.count(F.lit(1)).alias("held")).select(
        "region", "held", F.lit(0).alias("largest"), F.lit(None).cast("binary").alias("major")
    )
    maybe = stored(pairs_within(rooted, sizes, nodes, rule).select("u", "v"), "jaccard-possible")
    near = verified(docs, named, maybe, rule)
    removed(maybe, members, nodes)
    held = stored(named.groupBy("node").agg(F.count(F.lit(1)).alias("docs")), "jaccard-held")
    u, v = (held.select(F.col("node").alias(c), F.col("docs").alias(f"docs_{c}")) for c in "uv")
    return named, near.join(u, "u").join(v, "v").select("u", "v", "docs_u", "docs_v")


def link_counts(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Every document with its links: doc_id, digest, n_shingles, n_links.

    Documents of the same set link with each other; those without words with none.
    """
    named, near = _links(docs, rule or Rule())
    near = stored(near, "jaccard-weighted")
    ends = near.select(F.col("u").alias("node"), F.col("docs_v").alias("docs")).unionByName(
        near.select(F.col("v").alias("node"), F.col("docs_u").alias("docs"))
    )
    others = stored(ends.groupBy("node").agg(F.sum("docs").alias("others")), "jaccard-others")
    held = stored(named.groupBy("node").agg(F.count(F.lit(1)).alias("same")), "jaccard-held")
    counts = stored(
        held.join(others, "node", "left").select(
            "node", (F.col("same") - 1 + F.coalesce("others", F.lit(0))).alias("of_node")
        ),
        "jaccard-counts",
    )
    return named.select("doc_id", "digest", "n", "node").join(counts, "node").select(
        "doc_id",
        "digest",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("of_node")).otherwise(F.lit(0)).alias("n_links"),
    )


def keep_one_each(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One document of each component: the smallest doc_id; texts without words all stay."""
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")
    grouped = stored(memberships(docs, rule).filter(F.col("group").isNotNull()), "jaccard-grouped")
    firsts = stored(
        grouped.groupBy("group").agg(F.min(rank).alias("one"), F.count(F.lit(1)).alias("held")).select(
            "group", F.col("one.doc_id").alias("kept_id"), F.col("one.digest").alias("kept_digest"), "held"
        ),
        "jaccard-kept",
    )
    # Documents alone in their group stay where they are; only the others are looked up.
    several = firsts.filter("held > 1").select("group")
    touched = stored(
        grouped.join(several, "group", "left_semi").select(F.col("digest").alias("kept_digest")), "jaccard-touched"
    )
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    names = docs.columns
    rows = marked(
        docs.filter(worded).select(
            F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
            F.col("doc_id").alias("kept_id"),
            F.xxhash64("text").alias("kept_digest"),
        ),
        touched, "kept_digest", "touched",
    )
    kept = marked(firsts.select("kept_id", "kept_digest"), touched, "kept_digest", "touched").filter("touched")
    match = rows.filter("touched").alias("r").join(
        kept.alias("k"),
        F.col("r.kept_id").eqNullSafe(F.col("k.kept_id")) & (F.col("r.kept_digest") == F.col("k.kept_digest")),
        "left_semi",
    )
    one = match.dropDuplicates(["kept_id", "kept_digest"]).select("row.*")
    alone = rows.filter("NOT touched").select("row.*")
    return alone.unionByName(one).unionByName(docs.filter(~worded))
