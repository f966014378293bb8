"""Top-n, ranked top-n, and top-and-bottom of a frame of groups.

NULL sorts as the largest value: first when descending, last when ascending.
Ties go to the smallest tie column, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def _down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def ordering(measure: str, ties: Sequence[str], descending: bool = True) -> list[Column]:
    return [_down(measure) if descending else _up(measure), *map(_up, ties)]


def top_n(
    df: DataFrame, measure: str, n: int, ties: Sequence[str], descending: bool = True
) -> DataFrame:
    """The first n rows; each task keeps n rows before they meet."""
    return df.orderBy(*ordering(measure, ties, descending)).limit(n)


def ranked(
    df: DataFrame, measure: str, n: int, ties: Sequence[str], descending: bool = True
) -> DataFrame:
    """The first n rows with their row number.

    The window has one partition, but runs on the n rows that are left.
    """
    window = Window.orderBy(*ordering(measure, ties, descending))
    best = top_n(df, measure, n, ties, descending)
    return best.withColumn("ranking", F.row_number().over(window))


def bottom_n(df: DataFrame, measure: str, n: int, ties: Sequence[str]) -> DataFrame:
    """The last n rows of the descending order, found by reversing every key."""
    return df.orderBy(_up(measure), *map(_down, ties)).limit(n)


def top_bottom(df: DataFrame, measure: str, n: int, ties: Sequence[str]) -> DataFrame:
    """First n and last n rows; with fewer than 2n rows some appear twice."""
    top = top_n(df, measure, n, ties).withColumn("section", F.lit("top"))
    bottom = bottom_n(df, measure, n, ties).withColumn("section", F.lit("bottom"))
    return top.unionByName(bottom).orderBy(F.desc("section"), *ordering(measure, ties))


def first_name(
    name: str, measure: str, descending: bool = True, only: Column | None = None
) -> Column:
    """Top-1 as an aggregate, so one pass can answer several of them.

    Same order as ``top_n`` with ``name`` as tie column. ``only`` leaves out
    the rows where it is not true.
    """
    value, label = F.col(measure), F.col(name)
    key = F.struct(
        (value.isNotNull() if descending else value.isNull()).alias("a"),
        (-value if descending else value).alias("b"),
        label.isNull().alias("c"),
        label.alias("d"),
    )
    return F.min_by(label, key if only is None else F.when(only, key))
