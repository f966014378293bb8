"""How often each value occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.operators.ranking import top_n


def value_counts(df: DataFrame, key: str, alias: str, first_by: str) -> DataFrame:
    """Rows per non-null key, with the smallest ``first_by`` as ``first_seen``."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias(alias), F.min(first_by).alias("first_seen"))
    )


def most_frequent(df: DataFrame, key: str, n: int, alias: str, first_by: str) -> DataFrame:
    """The n most frequent keys; among equals the one that appears first."""
    counts = value_counts(df, key, alias, first_by)
    return top_n(counts, alias, n, ties=["first_seen", key]).drop("first_seen")
