"""Ranked and grouped reports over the order model.

Products, customers, suppliers and categories are reported by name: equal
names are one group.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.functions.dates import in_year, month_name
from orderboard.functions.labels import OTHER_PAYMENT, PAYMENT_LABELS, label_codes
from orderboard.functions.numbers import line_value
from orderboard.operators.dimensions import Extent, total, total_by_attributes
from orderboard.operators.ranking import ordering, ranked
from orderboard.plans.rollups import summed


def top_products_by_quantity(sales: DataFrame, n: int = 10) -> DataFrame:
    totals = summed(sales, "product_name", "quantity_sold")
    return ranked(totals, "quantity_sold", n, ["product_name"])


def top_products_by_lines(sales: DataFrame, n: int = 10) -> DataFrame:
    return ranked(summed(sales, "product_name", "line_count"), "line_count", n, ["product_name"])


def bottom_products_by_lines(sales: DataFrame, n: int = 10) -> DataFrame:
    """Fewest order lines among the products that were sold at all."""
    totals = summed(sales, "product_name", "line_count")
    return ranked(totals, "line_count", n, ["product_name"], descending=False)


def orders_per_customer(activity: DataFrame) -> DataFrame:
    totals = summed(activity, "company_name", "order_count")
    return totals.orderBy(*ordering("order_count", ["company_name"]))


def orders_per_payment_method(
    calendar: DataFrame,
    labels: Mapping[str, str] = PAYMENT_LABELS,
    default: str = OTHER_PAYMENT,
) -> DataFrame:
    """Orders per payment code, shown by label.

    The codes are the groups: every code without a label has its own row.
    """
    totals = summed(calendar, "payment_code", "row_count")
    return totals.select(
        label_codes(F.col("payment_code"), labels, default).alias("payment_method"),
        F.col("row_count").alias("order_count"),
    )


def orders_per_year(calendar: DataFrame) -> DataFrame:
    totals = summed(calendar, "order_year", "order_count")
    return totals.orderBy(F.col("order_year").asc_nulls_last()).select(
        F.col("order_year").cast("string").alias("order_year"),
        "order_count",
    )


def order_lines_per_product(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines of every product name, 0 for those never sold.

    Every product adds a 0 to its name, so one grouping answers without a join
    and NULL names are a group like any other.
    """
    zeros = products.select("product_name", F.lit(0).cast("long").alias("order_count"))
    sold = sales.select("product_name", "order_count")
    return summed(sold.unionByName(zeros), "product_name", "order_count")


def quantity_per_category(
    sales: DataFrame, categories: DataFrame, extent: Extent | None = None
) -> DataFrame:
    """``sales`` by ``category_id``, shown by category name."""
    by_id = summed(sales, "category_id", "quantity_sold")
    return total_by_attributes(
        by_id, categories, "category_id", ["category_name"], [total("quantity_sold", "quantity_sold")],
        extent=extent,
    )


def products_per_supplier(supplier_products: DataFrame) -> DataFrame:
    return supplier_products.select("company_name", "product_count").orderBy(
        *ordering("product_count", ["company_name"])
    )


def revenue_per_month(
    order_lines: DataFrame,
    orders: DataFrame,
    year: int,
    filter_lines: bool = True,
    extent: Extent | None = None,
) -> DataFrame:
    """Revenue per month of one year.

    Lines meet only the orders of that year: a range of order ids reaches the scan,
    and before any exchange the lines are tested against a filter of the year's ids.
    What is left is totalled by order and joined in that partitioning. Where ``extent``
    (of the largest year's orders) allows a broadcast, lines are joined first. Without
    ``filter_lines`` the filter is left out, for tables bucketed by ``order_id``,
    whose lines are not shuffled.
    """
    months = in_year(orders, "order_date", year).select(
        "order_id", F.month("order_date").alias("month_no")
    )
    totals = total_by_attributes(
        order_lines,
        months,
        "order_id",
        ["month_no"],
        [total("revenue", line_value())],
        within_keys=True,
        filter_keys=filter_lines,
        extent=extent,
    )
    return totals.orderBy("month_no").select(
        "month_no", month_name(F.col("month_no")).alias("month_name"), "revenue"
    )
