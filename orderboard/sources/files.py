"""Order tables and employees from Parquet or CSV."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderboard.model import SCHEMAS, OrderModel, reconciled


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, read with a declared schema.

    The header must name the schema's columns in order, and a malformed field
    fails the job rather than turning into NULL. An empty field is NULL.
    """
    return (
        spark.read.schema(schema)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path, header=True, sep=",", encoding="UTF-8")
    )


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Parquet; with a schema no job has to read footers to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_order_model(
    spark: SparkSession,
    folder: str,
    file_format: str = "parquet",
    tested: Collection[str] = (),
) -> OrderModel:
    """The six tables from ``folder/<table>``.

    Parquet types are those of the files: lossy ones are refused by column, or tested
    by value where ``tested`` names the column.
    """
    if file_format not in ("parquet", "csv"):
        raise ValueError(f"unknown format {file_format!r}")

    def reader(table: str, schema: T.StructType) -> Callable[[], DataFrame]:
        path = f"{folder.rstrip('/')}/{table}"
        if file_format == "csv":
            return lambda: read_csv(spark, path, schema)
        return lambda: reconciled(read_parquet(spark, path), table, tested)

    return OrderModel(**{table: reader(table, schema) for table, schema in SCHEMAS.items()})
