"""Share of total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.functions.numbers import percent, percent_text


def share_of_total(df: DataFrame, measure: str) -> DataFrame:
    """Add each row's percentage of the frame's own total.

    The total is a scalar subquery. A window over all rows would move them to
    one task; this way only partial sums meet, and the grouping below the frame
    is shuffled once because both branches use the same exchange.
    """
    total = df.select(F.sum(measure)).scalar()
    return df.withColumn("share_pct", percent(F.col(measure), total)).withColumn(
        "share_text", percent_text(F.col("share_pct"))
    )
