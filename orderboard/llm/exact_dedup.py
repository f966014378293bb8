"""Exact deduplication by an extendible-hash index of the texts on shared files.

Texts are equal when identical after every run of ASCII white space became one
space. The index finds all groups, for both ways of use; the work is in three steps.

1. *Directory.* Hashes are counted, and distinct ones counted by prefix. A bucket
   with more than ``capacity`` of them is split by doubling the directory, as deep
   as it takes for that bucket; the other buckets stay shallow. Its size is bounded
   by ``2 ** max_depth`` entries.
2. *Owners.* Each owner task takes a range of hashes with the texts themselves. It
   compares texts of one hash byte by byte, finds for each the document that stays
   and the size of its group, and chains the texts that share the hash. It writes
   (bucket, hash, chain, digest, keep_id, group_size) to shared files, one folder for
   each bucket.
3. *Probes.* ``memberships`` takes each document's bucket from the directory and meets
   the bucket's entries; ``drop_duplicates`` reads the rows that stay from the buckets.

A text moves once. Only hashes of more than one row in ``HOT_SHARE`` of all rows (and
more than ``HOT_ROWS``), of which there are at most ``HOT_SHARE``, have their copies
combined within map tasks before owners get them, as a range would put a third of all
rows into one task. That changes the way of those rows, not the groups.

The index's tables are files in the shared folder, so losing an executor repeats a
task, not the index.

Defined cases: NULL text counts as empty, and empty texts are one group. A NULL
doc_id comes after all others when the row that stays is chosen. Rows with equal
doc_id and text are one text; of them one stays. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderboard.llm.tables import SPACE, shuffles_removed, stored, whole_row
from orderboard.scratch import shared_folder

Hash = Callable[[Column], Column]

CAPACITY = 100_000
MAX_DEPTH = 16
HOT_SHARE = 10_000
HOT_ROWS = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def _ordered(doc_id: Column) -> Column:
    """Sorts NULL after every id."""
    return F.struct(doc_id.isNull().alias("missing"), doc_id.alias("doc_id"))


class Index(NamedTuple):
    entries: DataFrame  # hash, text_sha256, keep_id, group_size, chain, bucket and, if asked for, row
    lookup: DataFrame  # slot, bucket, depth


def hash_counts(hashes: DataFrame) -> DataFrame:
    """(hash, rows), stored."""
    return stored(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")), "dedup-hashes")


def frequent(counts: DataFrame, share: int = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """The hashes, at most ``share``, of more than one row in ``share``."""
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return counts.filter(F.col("rows") > max(least, total // share)).select("hash")


def directory(hashes: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(slot, bucket, depth): the bucket of each ``max_depth``-bit prefix of the hash.

    A slot's bucket is its shortest prefix that at most ``capacity`` distinct
    hashes share; that is the state in which doubling the directory ends.
    """
    counted = hashes.select("hash").distinct().groupBy(_slot(max_depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    levels = counted.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("depth"))
    prefix = F.expr(f"shiftrightunsigned(slot, {max_depth} - depth)")
    full = (
        levels.groupBy("depth", prefix.alias("prefix"))
        .agg(F.sum("n").alias("held"))
        .filter((F.col("held") <= capacity) | (F.col("depth") == max_depth))
    )
    # Fewer than 2 ** (max_depth + 1) rows.
    reached = levels.withColumn("prefix", prefix).join(F.broadcast(full), ["depth", "prefix"])
    return reached.groupBy("slot").agg(F.min("depth").alias("depth")).select(
        "slot", F.format_string("%02d-%d", F.col("depth"), prefix).alias("bucket"), "depth"
    )


def _slot(max_depth: int) -> Column:
    return F.shiftrightunsigned(F.col("hash"), 64 - max_depth)


def build_index(
    docs: DataFrame,
    counts: DataFrame,
    hash_of: Hash = F.xxhash64,
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
    with_rows: bool = False,
    hot: DataFrame | None = None,
) -> Index:
    """The index of ``docs``, written by bucket and read back.

    ``counts`` are the ``hash_counts`` of the documents' normalised texts, ``hot`` the
    hashes whose copies are combined first (``frequent(counts)``). ``with_rows`` adds
    ``row``, the document that stays.
    """
    spark = docs.sparkSession
    lookup = stored(directory(counts, capacity, max_depth), "dedup-directory")
    hot = F.broadcast(frequent(counts) if hot is None else hot)  # at most HOT_SHARE rows
    norm = normalised(F.col("row.text"))
    rank = F.struct(_ordered(F.col("row.doc_id")), F.col("row.text"))
    first = F.min_by("row", rank) if with_rows else F.struct(F.min("row.doc_id").alias("doc_id"), F.col("norm").alias("text"))

    rows = docs.select((whole_row(docs) if with_rows else F.struct("doc_id", "text")).alias("row"))
    keyed = rows.withColumn("hash", hash_of(norm))
    combined = keyed.join(hot, "hash", "left_semi").groupBy("hash", norm.alias("norm")).agg(
        first.alias("row"), F.count(F.lit(1)).alias("copies")
    )
    single = keyed.join(hot, "hash", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    columns = ["hash", "row", "copies"]
    owned = single.select(columns).union(combined.select(columns)).repartitionByRange("hash")

    kept = [F.min_by("row", rank).alias("row")] if with_rows else []
    texts = owned.groupBy("hash", norm.alias("norm")).agg(
        F.min("row.doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), *kept
    )
    chain = Window.partitionBy("hash").orderBy("text_sha256", F.col("keep_id").asc_nulls_last())
    chained = texts.withColumn("text_sha256", F.sha2("norm", 256)).drop("norm").withColumn(
        "chain", F.row_number().over(chain)
    )
    entries = chained.withColumn("slot", _slot(max_depth)).join(
        F.broadcast(lookup), "slot"  # at most 2 ** max_depth rows
    ).drop("slot", "depth")
    path = shared_folder(spark, "dedup-index")
    with shuffles_removed(spark):
        entries.write.partitionBy("bucket").parquet(path)
    return Index(spark.read.schema(entries.schema).parquet(path), lookup)


def probe(probes: DataFrame, index: Index, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Each of ``probes`` (doc_id, hash, text_sha256) with its entry, from the bucket
    that the directory names."""
    addressed = probes.withColumn("slot", _slot(max_depth)).join(F.broadcast(index.lookup), "slot")
    return addressed.join(index.entries, ["bucket", "hash", "text_sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "chain",
    )


def probes_of(docs: DataFrame, hash_of: Hash = F.xxhash64) -> DataFrame:
    """(doc_id, hash, text_sha256) of each document, stored."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    return stored(
        norm.select("doc_id", hash_of(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256")),
        "dedup-probes",
    )


def memberships(
    docs: DataFrame,
    hash_of: Hash = F.xxhash64,
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """Every document with its group: doc_id, keep_id, group_size, kept, text_sha256, chain.

    ``kept`` marks the rows with the group's smallest doc_id; if that id itself
    repeats with the same text, all its rows are marked and ``drop_duplicates``
    is what leaves one.
    """
    probes = probes_of(docs, hash_of)
    index = build_index(docs, hash_counts(probes), hash_of, capacity, max_depth)
    return probe(probes, index, max_depth)


def drop_duplicates(
    docs: DataFrame,
    hash_of: Hash = F.xxhash64,
    capacity: int = CAPACITY,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """The documents that stay: of equal texts the row with the smallest doc_id."""
    counts = hash_counts(docs.select(hash_of(normalised(F.col("text"))).alias("hash")))
    index = build_index(docs, counts, hash_of, capacity, max_depth, with_rows=True)
    return index.entries.select("row.*")
