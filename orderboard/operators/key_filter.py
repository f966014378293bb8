"""A filter of keys for rows that are about to be shuffled.

The keys of a side are hashed to the positions of a bit field; each page of the field
that has a bit set is one row. Rows of the other side look their key's bit up in the
broadcast pages, in the map tasks and before any exchange. A bit may be set by
another key, so rows pass that have no match, but none with a match is lost.

The field has ``BITS_OF_KEY`` bits for each row of the keys' side, counted by a
subquery when the plan runs, and never more than fit ``FILTER_LIMIT`` bytes. So the
broadcast is bounded however many keys there are; with many more keys than bits
everything passes. Building the plan runs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILTER_LIMIT = "orderboard.keyFilter.maxBytes"
DEFAULT_FILTER_LIMIT = 32 * 1024 * 1024
BITS_OF_KEY = 8
WORD = 64
WORDS_OF_PAGE = 64
PAGE = WORD * WORDS_OF_PAGE
# Bytes of a broadcast page besides its bits.
PAGE_OVERHEAD = 64


def bits_within(limit: int) -> int:
    """The largest power of two of bits whose pages fit the limit; 0 if one page does not."""
    pages = limit // (PAGE // 8 + PAGE_OVERHEAD)
    return PAGE << (pages.bit_length() - 1) if pages else 0


def configured_bits(df: DataFrame) -> int:
    return bits_within(int(df.sparkSession.conf.get(FILTER_LIMIT, str(DEFAULT_FILTER_LIMIT))))


def field_mask(keys: DataFrame, most: int) -> Column:
    """One less than the bits of the field, a power of two of at most ``most``."""
    wanted = F.ceil(F.log2(F.greatest(F.count(F.lit(1)) * BITS_OF_KEY, F.lit(PAGE)))).cast("int")
    size = F.least(wanted, F.lit(most.bit_length() - 1))
    return keys.select((F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1).alias("mask")).scalar()


def _in_page(position: Column) -> tuple[Column, Column, Column]:
    """The page, the word in it from 0, and the bit in that."""
    word = F.shiftright(position, WORD.bit_length() - 1)
    inside = word.bitwiseAND(F.lit(WORDS_OF_PAGE - 1).cast("long")).cast("int")
    bit = position.bitwiseAND(F.lit(WORD - 1).cast("long")).cast("int")
    return F.shiftright(position, PAGE.bit_length() - 1), inside, bit


def bit_pages(keys: DataFrame, position: Column) -> DataFrame:
    """(page, words) of the bits at these positions, one row for each ``PAGE`` bits at most."""
    page, word, bit = _in_page(F.col("position"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = (
        keys.select(position.alias("position"))
        .groupBy(page.alias("page"), word.alias("word"))
        .agg(F.bit_or(one).alias("bits"))
    )
    held = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    paged = words.groupBy("page").agg(held.alias("held"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(WORDS_OF_PAGE - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long"))
    )
    return paged.select("page", dense.alias("words"))


def common_key(facts: DataFrame, keys: DataFrame, key: str) -> Column | None:
    """``key`` as both sides hash it alike; None where their types differ for good."""
    kinds = {type(df.schema[key].dataType) for df in (facts, keys)}
    if kinds <= {T.ByteType, T.ShortType, T.IntegerType, T.LongType}:
        return F.col(key).cast("long")
    return F.col(key) if facts.schema[key].dataType == keys.schema[key].dataType else None


def may_match(facts: DataFrame, keys: DataFrame, key: str, bits: int | None = None) -> DataFrame:
    """The facts whose key may be among ``keys``; all those whose key is."""
    bits = configured_bits(facts) if bits is None else bits
    hashed = common_key(facts, keys, key)
    if not bits or hashed is None:
        return facts
    pages, page, is_set = _lookup(keys, key, hashed, bits)
    return facts.join(F.broadcast(pages), page & is_set, "left_semi")  # at most FILTER_LIMIT bytes


def marked(facts: DataFrame, keys: DataFrame, key: str, name: str, bits: int | None = None) -> DataFrame:
    """The facts with a boolean ``name``: whether the key may be among ``keys``.

    Equal keys are marked alike in every frame that is marked by the same ``keys``.
    """
    bits = configured_bits(facts) if bits is None else bits
    hashed = common_key(facts, keys, key)
    if not bits or hashed is None:
        return facts.withColumn(name, F.lit(True))
    pages, page, is_set = _lookup(keys, key, hashed, bits)
    found = facts.join(F.broadcast(pages), page, "left")  # at most FILTER_LIMIT bytes
    return found.withColumn(name, F.coalesce(is_set, F.lit(False))).drop("filter_page", "filter_words")


def _lookup(keys: DataFrame, key: str, hashed: Column, bits: int) -> tuple[DataFrame, Column, Column]:
    """The pages, the condition that joins one, and whether the key's bit in it is set."""
    position = F.xxhash64(hashed).bitwiseAND(field_mask(keys, bits))
    pages = bit_pages(keys.filter(F.col(key).isNotNull()), position).toDF("filter_page", "filter_words")
    page, word, bit = _in_page(position)
    is_set = F.call_function("getbit", F.get("filter_words", word), bit) == 1
    return pages, page == F.col("filter_page"), is_set
