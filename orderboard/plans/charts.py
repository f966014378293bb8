"""Datasets that only charts show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.functions.dates import month_name
from orderboard.functions.numbers import bar_label
from orderboard.operators.ranking import top_bottom, top_n


def orders_per_month(calendar: DataFrame) -> DataFrame:
    """Orders per month in calendar order; ``calendar`` must hold one year."""
    totals = calendar.groupBy("month_no").agg(F.sum("order_count").alias("order_count"))
    return totals.orderBy("month_no").select(
        "month_no", month_name(F.col("month_no")).alias("month_name"), "order_count"
    )


def top_bottom_products(order_lines_per_product: DataFrame, n: int = 5) -> DataFrame:
    return top_bottom(order_lines_per_product, "order_count", n, ["product_name"])


def top_bottom_customers(orders_per_customer: DataFrame, n: int = 5) -> DataFrame:
    return top_bottom(orders_per_customer, "order_count", n, ["company_name"])


def top_customers(orders_per_customer: DataFrame, n: int = 7) -> DataFrame:
    return top_n(orders_per_customer, "order_count", n, ["company_name"])


def top_suppliers(products_per_supplier: DataFrame, n: int = 7) -> DataFrame:
    return top_n(products_per_supplier, "product_count", n, ["company_name"])


def with_bar_labels(df: DataFrame, measure: str) -> DataFrame:
    return df.withColumn("bar_label", bar_label(measure))
