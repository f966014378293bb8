"""KPI cards: one row, one column each, and the board that holds them all.

On empty tables counts are 0, other aggregates NULL, and top-1 cards have no
row; the board then shows NULL for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderboard.functions.dates import day_text
from orderboard.functions.numbers import line_value, rounded_avg
from orderboard.operators.ranking import first_name, top_n
from orderboard.plans.rollups import summed


def _row_total(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def order_count(orders: DataFrame) -> DataFrame:
    return _row_total(orders, "order_count")


def customer_count(customers: DataFrame) -> DataFrame:
    return _row_total(customers, "customer_count")


def supplier_count(suppliers: DataFrame) -> DataFrame:
    return _row_total(suppliers, "supplier_count")


def orders_without_rep(orders: DataFrame) -> DataFrame:
    return _row_total(orders.filter(F.col("employee_id").isNull()), "orders_without_rep")


def priciest_product(products: DataFrame) -> DataFrame:
    """Every product at the highest list price."""
    highest = products.select(F.max("unit_price")).scalar()
    return products.filter(F.col("unit_price") == highest).select("product_name")


def best_selling_product(sales: DataFrame) -> DataFrame:
    totals = summed(sales, "product_name", "quantity_sold")
    return top_n(totals, "quantity_sold", 1, ["product_name"]).select("product_name")


def top_customer(activity: DataFrame) -> DataFrame:
    totals = summed(activity, "company_name", "order_count")
    return top_n(totals, "order_count", 1, ["company_name"]).select("company_name")


def max_freight_customer(activity: DataFrame) -> DataFrame:
    """Customer of the highest single freight; one whose freights are all NULL wins."""
    highest = activity.groupBy("company_name").agg(F.max("max_freight").alias("max_freight"))
    return top_n(highest, "max_freight", 1, ["company_name"]).select("company_name")


def total_revenue(order_lines: DataFrame) -> DataFrame:
    """Value of all lines, also of those without a known product."""
    return order_lines.agg(F.sum(line_value()).alias("total_revenue"))


def avg_price(products: DataFrame) -> DataFrame:
    return products.agg(rounded_avg("unit_price").alias("avg_price"))


def top_supplier(supplier_products: DataFrame) -> DataFrame:
    return top_n(supplier_products, "row_count", 1, ["company_name"]).select("company_name")


def latest_order(orders: DataFrame) -> DataFrame:
    return orders.agg(day_text(F.max("order_date")).alias("latest_order"))


def _stock_extreme(products: DataFrame, aggregate, descending: bool) -> DataFrame:
    stock = products.groupBy("product_name").agg(aggregate("units_in_stock").alias("stock"))
    return top_n(stock, "stock", 1, ["product_name"], descending).select("product_name")


def most_stock(products: DataFrame) -> DataFrame:
    return _stock_extreme(products, F.max, descending=True)


def least_stock(products: DataFrame) -> DataFrame:
    return _stock_extreme(products, F.min, descending=False)


def _cards(one_row: DataFrame, **values: Column) -> DataFrame:
    texts = one_row.select(*[v.cast("string").alias(k) for k, v in values.items()])
    return texts.unpivot([], list(values), "kpi", "value")


def kpi_board(
    calendar: DataFrame,
    activity: DataFrame,
    sales: DataFrame,
    revenue: DataFrame,
    supplier_products: DataFrame,
    products: DataFrame,
    customers: DataFrame,
    suppliers: DataFrame,
) -> DataFrame:
    """All fourteen cards as ``(kpi, value)`` rows.

    Cards on the same rollup are aggregates of one pass over it. ``revenue`` is
    the total-revenue card: kept apart because its wide decimal would slow the
    grouping of the lines down more than a second scan of two columns costs.
    Where several products share the highest price the board shows the first by
    name.
    """
    order_cards = calendar.agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("orders"),
        F.max("last_order_date").alias("last_date"),
        F.coalesce(F.sum("without_rep"), F.lit(0)).alias("without_rep"),
    )
    by_customer = activity.groupBy("company_name").agg(
        F.sum("order_count").alias("order_count"), F.max("max_freight").alias("max_freight")
    )
    customer_cards = by_customer.agg(
        first_name("company_name", "order_count").alias("most_orders"),
        first_name("company_name", "max_freight").alias("most_freight"),
    )
    sales_cards = summed(sales, "product_name", "quantity_sold").agg(
        first_name("product_name", "quantity_sold").alias("best")
    )
    by_product = products.groupBy("product_name").agg(
        F.max("unit_price").alias("max_price"),
        F.sum("unit_price").alias("price_sum"),
        F.count("unit_price").alias("price_count"),
        F.max("units_in_stock").alias("max_stock"),
        F.min("units_in_stock").alias("min_stock"),
    )
    product_cards = by_product.agg(
        first_name("product_name", "max_price", only=F.col("max_price").isNotNull()).alias("priciest"),
        F.sum("price_sum").alias("price_sum"),
        F.sum("price_count").alias("price_count"),
        first_name("product_name", "max_stock").alias("most_stock"),
        first_name("product_name", "min_stock", descending=False).alias("least_stock"),
    )
    supplier_cards = supplier_products.agg(first_name("company_name", "row_count").alias("top"))
    # A sum of sums is wider; the type of the card's sum gives the card's digits.
    card_sum = products.select(F.sum("unit_price")).schema[0].dataType
    price_mean = F.round(
        F.col("price_sum").cast(card_sum) / F.when(F.col("price_count") > 0, F.col("price_count")), 2
    )
    boards = [
        _cards(
            order_cards,
            order_count=F.col("orders"),
            latest_order=day_text(F.col("last_date")),
            orders_without_rep=F.col("without_rep"),
        ),
        _cards(
            customer_cards,
            top_customer=F.col("most_orders"),
            max_freight_customer=F.col("most_freight"),
        ),
        _cards(sales_cards, best_selling_product=F.col("best")),
        _cards(revenue, total_revenue=F.col("total_revenue")),
        _cards(
            product_cards,
            priciest_product=F.col("priciest"),
            avg_price=price_mean,
            most_stock=F.col("most_stock"),
            least_stock=F.col("least_stock"),
        ),
        _cards(supplier_cards, top_supplier=F.col("top")),
        _cards(customer_count(customers), customer_count=F.col("customer_count")),
        _cards(supplier_count(suppliers), supplier_count=F.col("supplier_count")),
    ]
    return reduce(DataFrame.unionByName, boards)
