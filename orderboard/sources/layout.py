"""A stored layout as an ``OrderModel``: partitioned by year, bucketed by order."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderboard.model import SCHEMAS, OrderModel
from orderboard.operators.extents import from_text
from orderboard.sinks.layout import BUCKET_KEY, BUCKETED, YEAR, committed
from orderboard.sources.files import read_parquet


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def _registered(spark: SparkSession, path: str, table: str, schema: T.StructType, buckets: int, by_year: bool) -> DataFrame:
    """Declare the files of one table to the session's catalog; no data is read."""
    if not spark.catalog.tableExists(table):
        year = f", `{YEAR}` int" if by_year else ""
        partitions = f"PARTITIONED BY (`{YEAR}`)" if by_year else ""
        spark.sql(
            f"CREATE TABLE {table} ({_columns(schema)}{year}) USING parquet {partitions}"
            f" CLUSTERED BY (`{BUCKET_KEY}`) SORTED BY (`{BUCKET_KEY}`) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        if by_year:
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return spark.table(table)


def order_model(spark: SparkSession, folder: str) -> OrderModel:
    """The last committed layout below ``folder``, with its measured record."""
    note = committed(spark, folder)
    root = f"{folder.rstrip('/')}/tables/{note['name']}"

    def reader(table: str) -> Callable[[], DataFrame]:
        schema = T.StructType.fromJson(json.loads(note["schemas"][table]))
        path = f"{root}/{table}"
        if table not in BUCKETED:
            return lambda: read_parquet(spark, path, schema)
        name = f"layout_{note['name']}_{table}"
        return lambda: _registered(spark, path, name, schema, note["buckets"], table == "orders")

    model = OrderModel(**{table: reader(table) for table in SCHEMAS})
    model.extents = from_text(note["extents"])
    model.by_order = True
    return model
