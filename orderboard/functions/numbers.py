"""Money, averages and the number texts charts show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_value(quantity: str = "quantity", unit_price: str = "unit_price") -> Column:
    return F.col(quantity) * F.col(unit_price)


def rounded_avg(column: str | Column, places: int = 2) -> Column:
    """Average of the non-null values, rounded half up.

    Divides the exact sum by the count: ``avg`` of a decimal keeps only four
    more digits, so rounding its result would round twice.
    """
    return F.round(F.sum(column) / F.count(column), places)


def percent(part: Column, total: Column) -> Column:
    """NULL where the part is NULL or the total is 0."""
    return F.round(F.try_divide(part.cast("double") * 100.0, total.cast("double")), 1)


def percent_text(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share))


def bar_label(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")
