"""The measured record of a model's dimensions.

Which plan totals facts per dimension attribute depends on how large the dimension is
and how many of its keys share an attribute. That is measured once for a model, here,
and kept with it or as text beside its files; building a report then runs nothing.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.model import OrderModel
from orderboard.operators.dimensions import ROW_OVERHEAD, VALUE_WIDTH, Extent, measure

Use = tuple[str, tuple[str, ...]]

# (table, attributes that reports group by) and the table's key.
USES: dict[Use, str] = {
    ("products", ("product_name",)): "product_id",
    ("products", ("category_id",)): "product_id",
    ("products", ("product_name", "category_id")): "product_id",
    ("customers", ("company_name",)): "customer_id",
    ("suppliers", ("company_name",)): "supplier_id",
    ("categories", ("category_name",)): "category_id",
}
# Orders of one year by month.
MONTHS: Use = ("orders", ("order_date",))
MONTHS_OF_YEAR = 12


def largest_year(orders: DataFrame) -> Extent:
    """The extent of (order_id, month) for the year with most orders."""
    per_year = orders.groupBy(F.year("order_date")).agg(F.count(F.lit(1)).alias("n"))
    most = per_year.agg(F.max("n")).first()[0] or 0
    return Extent(most * (ROW_OVERHEAD + 2 * VALUE_WIDTH), most, MONTHS_OF_YEAR)


def measured(model: OrderModel) -> dict[Use, Extent]:
    """One pass over each dimension and one over the orders' dates."""
    found = {
        (table, by): measure(model.table(table).select(key, *by), key) for (table, by), key in USES.items()
    }
    return found | {MONTHS: largest_year(model.orders)}


def as_text(extents: Mapping[Use, Extent]) -> str:
    return json.dumps([[table, list(by), *extent] for (table, by), extent in sorted(extents.items())])


def from_text(text: str) -> dict[Use, Extent]:
    return {(table, tuple(by)): Extent(*numbers) for table, by, *numbers in json.loads(text)}
