"""From raw documents to packed training sequences, in five stored stages.

Each stage takes the documents its predecessor kept and returns documents with
the same columns; the last returns pieces of sequences with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderboard.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from orderboard.llm.queries import held_out
from orderboard.llm.tables import read_table, stored

# Near copies: five-word shingles, similarity 0.8 or more.
NEAR = jaccard_join.Rule(size=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; a third of the labels stay out of training."""
    labels = read_table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, labels.filter(~held_out()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one_each(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A trained model and tokenization are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
