"""SQL text over the order model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderboard.model import SCHEMAS, OrderModel


def run_sql(spark: SparkSession, text: str, model: OrderModel, **args: object) -> DataFrame:
    """Run a statement that names tables as ``{orders}`` and parameters as ``:year``."""
    used = {name: model.table(name) for name in SCHEMAS if "{" + name + "}" in text}
    return spark.sql(text, args=args or None, **used)
