"""The aggregates that reports share.

A report called on its own asks for the coarsest rollup that answers it, and
Catalyst drops the measures it does not read. A suite run stores finer ones
once and answers every report from them. Either way reports re-aggregate by
name, so they accept a rollup of any granularity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.operators.dimensions import (
    Extent,
    largest,
    non_null_count,
    row_count,
    total,
    total_by_attributes,
)


def product_sales(
    order_lines: DataFrame,
    products: DataFrame,
    by: Sequence[str] = ("product_name",),
    extent: Extent | None = None,
) -> DataFrame:
    """Sales per product attribute, of lines whose product exists."""
    measures = [
        total("quantity_sold", "quantity"),
        row_count("line_count"),
        non_null_count("order_count", "order_id"),
    ]
    return total_by_attributes(order_lines, products, "product_id", by, measures, extent=extent)


def customer_activity(
    orders: DataFrame,
    customers: DataFrame,
    by: Sequence[str] = ("company_name",),
    extent: Extent | None = None,
) -> DataFrame:
    """Orders and highest freight per customer attribute or order column."""
    measures = [non_null_count("order_count", "order_id"), largest("max_freight", "freight")]
    return total_by_attributes(orders, customers, "customer_id", by, measures, extent=extent)


def order_calendar(orders: DataFrame, *by: str) -> DataFrame:
    """Order counts per ``by``; without it one row over all orders."""
    return orders.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("order_id").alias("order_count"),
        F.max("order_date").alias("last_order_date"),
        F.count_if(F.col("employee_id").isNull()).alias("without_rep"),
    )


def supplier_products(
    products: DataFrame, suppliers: DataFrame, extent: Extent | None = None
) -> DataFrame:
    """Products per supplier name."""
    measures = [row_count("row_count"), non_null_count("product_count", "product_id")]
    return total_by_attributes(
        products, suppliers, "supplier_id", ["company_name"], measures, extent=extent
    )


def with_periods(orders: DataFrame) -> DataFrame:
    """Orders with the period columns that rollups group on.

    A source partitioned by ``order_year`` brings that column along.
    """
    periods = {"order_year": F.year("order_date"), "month_no": F.month("order_date")}
    return orders.withColumns({n: p for n, p in periods.items() if n not in orders.columns})


def summed(rollup: DataFrame, key: str, *measures: str) -> DataFrame:
    return rollup.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])
