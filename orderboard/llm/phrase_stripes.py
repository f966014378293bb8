"""Phrases whose words go together, by the stripes pattern.

A stripe belongs to a language and a prefix of 0 to ``max_words`` - 1 words: an
associative counter of the words that follow the prefix within a piece of text. Tasks
count stripes for a chunk of text at a time, stripes of a prefix meet and are added
elementwise, and what reaches ``min_count`` stays as (next word, count). From these
stripes come the candidates (prefix and next word), the total of each prefix (its
entry in the stripe of the prefix one word shorter; for the empty prefix the words
of the language), the parts that cuts of a candidate need, and, as the largest entry
of a stripe and the largest among equal endings, the most frequent phrase one word
longer on either side. A longer phrase is never more frequent than those it holds,
so one word longer is enough to tell what is subsumed.

There is one pass over the texts for each prefix length. A phrase of ``min_count``
occurrences has no rarer part, so a pass counts only where the words before the
last and those after the first are frequent. Tasks test that with a bit filter of
``FILTER_BITS`` bits for each frequent phrase, at most ``bit_filter.MAX_BITS`` in
all; one that is fuller lets more pass, and the counts stay exact either way.

A prefix that is at least a thousandth of all words (``HEAVY``; at most a thousand
prefixes) is dealt by next word into as many segments as there are shuffle
partitions, and so is the empty prefix. Lookups of such parts are broadcast. Counts
meet as 64-bit integers and scores are worked out as decimals of 38 digits.

Defined cases: NULL text is empty, NULL language is ``und``; empty texts and tables
give no phrase. Repeated rows count each time. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderboard.llm import bit_filter
from orderboard.llm.tables import stored

MIN_COUNT = 30
MAX_WORDS = 4
SUBSUMED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
NO_LANGUAGE = "und"

CHUNK_BYTES = 6 << 20
FILTER_BITS = 16
HEAVY = 1000
SHARES = 64

# Ends of pieces become a byte that UTF-8 never has; A-Z become a-z.
BOUNDARY = b"\xff"
_FOLD = bytes.maketrans(
    b".,;:!?\n\x0b\x0c\r" + bytes(range(ord("A"), ord("Z") + 1)),
    BOUNDARY * 10 + bytes(range(ord("a"), ord("z") + 1)),
)
_MIX = np.uint64(0x9E3779B97F4A7C15)

COUNTED = "lang string, prefix string, segment int, nexts binary, counts binary"
STRIPE = "lang string, prefix string, total long, extensions array<struct<next: string, count: long>>"


class _Numbers(dict):
    """Numbers for words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Chunk:
    """The words of some texts of one language, as numbers; 0 is the end of a piece."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        numbers = _Numbers({BOUNDARY: 0})
        words = (BOUNDARY.join(texts).translate(_FOLD).replace(BOUNDARY, b" \xff ") + b" \xff").split()
        self.lang = lang
        self.ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.vocabulary = list(numbers)
        self.spaced = [word + b" " for word in self.vocabulary]
        self.lengths = np.fromiter(map(len, self.vocabulary), np.int64, len(self.vocabulary))
        self.hashes = word_hashes(lang, self.vocabulary)
        # Words left in the piece from each place on.
        ends = np.flatnonzero(self.ids == 0)
        self.left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(words))

    def places(self, words: int, frequent: np.ndarray | None) -> np.ndarray:
        """Where phrases of so many words begin whose parts, one word shorter, may be frequent."""
        at = np.flatnonzero(self.left >= words)
        if frequent is None or not len(at):
            return at
        part = np.flatnonzero(self.left >= words - 1)
        held = np.zeros(len(self.ids) + 1, bool)
        hashed = phrase_hashes([self.hashes[self.ids[part + i]] for i in range(words - 1)])
        held[part] = filter_holds(frequent, hashed)
        return at[held[at] & held[at + 1]]

    def text(self, at: int, words: int) -> bytes:
        return b" ".join([self.vocabulary[i] for i in self.ids[at : at + words].tolist()])

    def stripes(self, length: int, frequent: np.ndarray | None, heavy: set, segments: int) -> pa.RecordBatch:
        """Rows ``COUNTED`` of this chunk for prefixes of ``length`` words."""
        at = self.places(length + 1, frequent)
        prefix = self.ids[at] if length else np.zeros(len(at), np.int64)
        for i in range(1, length):
            _, prefix = np.unique(prefix << 32 | self.ids[at + i], return_inverse=True)
        both, first, counts = np.unique(
            prefix << 32 | self.ids[at + length], return_index=True, return_counts=True
        )
        heads = _heads(both >> 32)
        if length == 1:
            names = [self.vocabulary[i] for i in self.ids[at[first[heads]]].tolist()]
        else:
            names = [self.text(at[i], length) for i in first[heads].tolist()]
        stripe = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(both)]))
        following = both & 0xFFFFFFFF
        split = np.array([not length or (self.lang, name) in heavy for name in names], bool)
        segment = np.zeros(len(both), np.int64)
        if split.any():
            dealt = (self.hashes[following] % np.uint64(segments)).astype(np.int64)
            segment = np.where(split[stripe], dealt, 0)
            order = np.argsort(stripe * segments + segment, kind="stable")
            stripe, segment, following, counts = (x[order] for x in (stripe, segment, following, counts))
        heads = _heads(stripe * segments + segment)
        # Each word has a space behind it, so the words of a row are a slice of one text.
        behind = np.cumsum(self.lengths[following] + 1)
        cuts = np.r_[heads, len(stripe)]
        data = b"".join([self.spaced[i] for i in following.tolist()])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.lang] * len(heads), pa.string()),
                pa.array([names[i] for i in stripe[heads].tolist()], pa.binary()).cast(pa.string()),
                pa.array(segment[heads].astype(np.int32)),
                _slices(data, np.r_[0, behind][cuts]),
                _slices(counts.astype("<i8").tobytes(), 8 * cuts),
            ],
            names=["lang", "prefix", "segment", "nexts", "counts"],
        )


def _slices(data: bytes, cuts: np.ndarray) -> pa.Array:
    """The parts of ``data`` between neighbouring cuts."""
    offsets = pa.py_buffer(cuts.astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data)])


def _heads(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]][: len(sorted_keys)])


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hashes(words: list[np.ndarray]) -> np.ndarray:
    """A hash of phrases from the hashes of their first words, second words and so on."""
    mixed = np.zeros_like(words[0])
    for word in words:
        mixed = (mixed ^ word) * _MIX
        mixed ^= mixed >> np.uint64(31)
    return mixed


def filter_positions(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [(hashed & mask).astype(np.int64), ((hashed >> np.uint64(32)) & mask).astype(np.int64)]


def filter_holds(frequent: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    one, two = filter_positions(hashed, len(frequent) * 8)
    return bit_filter.holds(frequent, one) & bit_filter.holds(frequent, two)


def filter_of(phrases: DataFrame, count: int) -> np.ndarray:
    """The bits of phrases (lang, phrase). The filter holds repeats, so each is sent twice."""
    bits = bit_filter.size_for(count, FILTER_BITS)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in range(2))
            by_lang = defaultdict(list)
            for lang, text in zip(langs, texts, strict=True):
                by_lang[lang].append(text.encode().split(b" "))
            found = [np.zeros(0, np.int64)]
            for lang, rows in by_lang.items():
                columns = [word_hashes(lang, list(column)) for column in zip(*rows, strict=True)]
                found += filter_positions(phrase_hashes(columns), bits)
            yield bit_filter.sent(np.repeat(np.concatenate(found), 2), bits)

    return bit_filter.repeats(phrases.select("lang", "phrase").mapInArrow(fill, bit_filter.SENT), bits)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts of one language together, some megabytes at a time."""
    waiting, size, total = defaultdict(list), defaultdict(int), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            data = text.as_py()
            waiting[lang].append(data)
            size[lang] += len(data)
            total += len(data)
            full = [lang] if size[lang] >= CHUNK_BYTES else list(waiting) if total >= 4 * CHUNK_BYTES else []
            for each in full:
                total -= size.pop(each)
                yield Chunk(each, waiting.pop(each))
    for lang, texts in waiting.items():
        yield Chunk(lang, texts)


ENTRY = pa.struct([("next", pa.string()), ("count", pa.int64())])


def added(batch: pa.RecordBatch, min_count: int, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
    """Rows ``COUNTED``, equal keys together, added elementwise.

    Returns rows ``STRIPE``, and unless this is the ``last`` batch the sum of its last
    key apart, as a row that the next batch may go on with.
    """
    keys = [batch.column(name) for name in ("lang", "prefix", "segment")]
    new = np.zeros(batch.num_rows, bool)
    for key in keys:
        new[1:] |= pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    new[0] = True
    numbers = _Numbers()
    words = b"".join(batch.column("nexts").to_pylist()).split()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    counts = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i8")
    sizes = pc.binary_length(batch.column("counts")).to_numpy() // 8
    both = np.repeat(np.cumsum(new) - 1, sizes) << 32 | ids
    order = np.argsort(both)
    both = both[order]
    heads = _heads(both)
    sums = np.add.reduceat(counts[order], heads)
    of, following = both[heads] >> 32, both[heads] & 0xFFFFFFFF
    first = np.flatnonzero(new)
    totals = np.add.reduceat(sums, _heads(of))
    vocabulary, rest, done = list(numbers), None, len(first)
    if not last:
        done -= 1
        mine = of == done
        nexts = b" ".join([vocabulary[i] for i in following[mine].tolist()]) + b" "
        rest = pa.RecordBatch.from_arrays(
            [key.slice(int(first[-1]), 1) for key in keys]
            + [pa.array([nexts], pa.binary()), pa.array([sums[mine].astype("<i8").tobytes()], pa.binary())],
            names=batch.schema.names,
        )
    kept = (sums >= min_count) & (of < done)
    held = np.bincount(of[kept], minlength=len(first))[:done]
    lang, prefix = (key.take(pa.array(first[:done])) for key in keys[:2])
    # A prefix without a frequent extension matters only for the words of a language.
    rows = np.flatnonzero((held > 0) | pc.equal(prefix, "").to_numpy(zero_copy_only=False))
    entries = pa.StructArray.from_arrays(
        [
            pa.array([vocabulary[i] for i in following[kept].tolist()], pa.binary()).cast(pa.string()),
            pa.array(sums[kept], pa.int64()),
        ],
        fields=list(ENTRY),
    )
    offsets = pa.array(np.r_[0, np.cumsum(held[rows])].astype(np.int32))
    out = [lang.take(pa.array(rows)), prefix.take(pa.array(rows)), pa.array(totals[rows]), pa.ListArray.from_arrays(offsets, entries)]
    return pa.RecordBatch.from_arrays(out, names=["lang", "prefix", "total", "extensions"]), rest


def merged_stripes(counted: DataFrame, min_count: int) -> DataFrame:
    """Rows ``STRIPE``: the sum of each stripe, entries of at least ``min_count``."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                found, rest = added(batch if rest is None else pa.concat_batches([rest, batch]), min_count, False)
                yield found
        if rest is not None:
            yield added(rest, min_count, True)[0]

    key = ["lang", "prefix", "segment"]
    return counted.repartition(*key).sortWithinPartitions(*key).mapInArrow(merge, STRIPE)


def stripes(
    docs: DataFrame, length: int, frequent: np.ndarray | None, heavy: set, min_count: int
) -> DataFrame:
    """The merged stripes of prefixes of ``length`` words, stored."""
    spark = docs.sparkSession
    segments = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(frequent)  # at most bit_filter.MAX_BITS bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            yield chunk.stripes(length, shared.value, heavy, segments)

    texts = docs.select(
        F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return stored(merged_stripes(texts.mapInArrow(count, COUNTED), min_count), f"phrase-stripes-{length}")


def phrases_of(merged: DataFrame, length: int) -> DataFrame:
    """(lang, prefix, phrase, words, f): the extensions of prefixes of ``length`` words."""
    entries = merged.select("lang", "prefix", F.explode("extensions").alias("e"))
    phrase = F.concat("prefix", F.lit(" "), "e.next") if length else F.col("e.next")
    return entries.select(
        "lang", "prefix", phrase.alias("phrase"), F.lit(length + 1).alias("words"), F.col("e.count").alias("f")
    )


def exact(count: str | Column) -> Column:
    return (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)")


def score(a: str, l: str, r: str) -> Column:
    """floor(``SCALE`` * a / (l + r)) without rounding before."""
    return F.expr(f"({SCALE} * CAST({a} AS decimal(20,0))) div (CAST({l} AS decimal(20,0)) + CAST({r} AS decimal(20,0)))")


def with_count(rows: DataFrame, part: str, counts: DataFrame, often: Column, name: str) -> DataFrame:
    """``rows`` with the count of ``part``. Few parts are very frequent; they are broadcast."""
    known = counts.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("known"), F.col("f").alias("found"))
    heavy = F.broadcast(counts.filter(often).select(
        F.col("lang").alias("of_lang"), F.col("phrase").alias("heavy"), F.col("f").alias("heavy_f")
    ))
    rows = rows.join(heavy, (F.col("lang") == F.col("of_lang")) & (F.col(part) == F.col("heavy")), "left")
    # No phrase has two spaces in a row: such rows meet nothing, each in its own place.
    light = F.when(F.col("heavy").isNull(), F.col(part)).otherwise(F.concat(F.lit("  "), "phrase"))
    rows = rows.withColumn("light", light).join(
        known, (F.col("lang") == F.col("in_lang")) & (F.col("light") == F.col("known")), "left"
    )
    return rows.withColumn(name, F.coalesce("heavy_f", "found")).drop(
        "of_lang", "heavy", "heavy_f", "light", "in_lang", "known", "found"
    )


def unsubsumed(counts: DataFrame, percent: int) -> DataFrame:
    """Phrases of two words or more that no longer phrase nearly always holds."""
    two = counts.filter("words >= 2")
    longer = counts.filter("words >= 3")
    ending = F.expr("substr(phrase, instr(phrase, ' ') + 1)")
    inside = longer.select("lang", F.col("prefix").alias("part"), "f").unionByName(
        longer.select("lang", ending.alias("part"), "f")
    )
    most = inside.groupBy(F.col("lang").alias("in_lang"), "part").agg(F.max("f").alias("most"))
    met = two.join(most, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")), "left")
    subsumed = exact("most") * 100 >= exact("f") * percent
    return met.filter(~F.coalesce(subsumed, F.lit(False))).select("lang", "phrase", F.col("f").alias("a"))


def mine(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    subsumed_percent: int = SUBSUMED_PERCENT,
) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    merged = stripes(docs, 0, None, set(), min_count)
    words = stored(merged.groupBy("lang").agg(F.sum("total").alias("n")), "phrase-words")
    all_words = words.agg(F.sum("n")).first()[0] or 0
    often = F.col("f") * HEAVY >= all_words
    found = [phrases_of(merged, 0)]
    for length in range(1, max_words):
        count = found[-1].count()
        if not count:
            break
        heavy = {(r["lang"], r["phrase"].encode()) for r in found[-1].filter(often).collect()}  # at most HEAVY
        merged = stripes(docs, length, filter_of(found[-1], count), heavy, min_count)
        found.append(phrases_of(merged, length))
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    counts = stored(counts, "phrase-counts")

    split = unsubsumed(counts, subsumed_percent).withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(w, 1, k), ' ')").alias("left_part"),
        F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("right_part"),
    )
    parts = counts.filter(F.col("words") < max_words)
    cuts = with_count(cuts, "left_part", parts, often, "l")
    cuts = with_count(cuts, "right_part", parts, often, "r")
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r", "a")).alias("cut")
    )
    scored = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    # The first of each share hold the first of all, so one task ranks SHARES * top at most.
    share, order = F.pmod(F.hash("phrase"), F.lit(SHARES)), [F.desc("score"), F.desc("a"), "phrase"]
    for parts in (["lang", share], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy(*order))
        scored = scored.withColumn("rank", place).filter(F.col("rank") <= top)
    return scored.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
