"""The order model stored for its reports: by year and by order.

Orders are partitioned by year and, like their lines, bucketed and sorted by
``order_id`` into the same number of buckets. A report of one year reads that year's
folders only, and lines meet their orders without an exchange. Each task writes one
bucket, so there is one file for each bucket and year.

A layout is a folder of tables under a version of its own. A text that names the
version, its buckets and the measured record of its dimensions is committed when all
tables are written, so readers see a whole layout or the one before it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderboard.model import SCHEMAS, OrderModel
from orderboard.operators.extents import as_text, measured
from orderboard.sinks import versions

BUCKET_KEY = "order_id"
BUCKETED = ("orders", "order_lines")
YEAR = "order_year"


def with_year(orders: DataFrame) -> DataFrame:
    return orders.withColumn(YEAR, F.year("order_date"))


def _write_bucketed(df: DataFrame, path: str, table: str, buckets: int) -> None:
    # The exchange deals rows as buckets do, by the hash of the key.
    writer = df.repartition(buckets, BUCKET_KEY).write.format("parquet").option("path", path)
    if YEAR in df.columns:
        writer = writer.partitionBy(YEAR)
    writer.bucketBy(buckets, BUCKET_KEY).sortBy(BUCKET_KEY).saveAsTable(table)


def write_layout(model: OrderModel, folder: str, buckets: int, keep: int | None = None) -> int:
    """Write all six tables below ``folder`` and commit them; returns the version number.

    ``buckets`` should make files of some hundred megabytes. With ``keep`` only so many
    versions stay.
    """
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    spark = model.orders.sparkSession
    name = uuid.uuid4().hex
    root = f"{folder.rstrip('/')}/tables/{name}"
    for table in SCHEMAS:
        df, path = model.table(table), f"{root}/{table}"
        if table in BUCKETED:
            scratch = f"layout_{name}_{table}"
            _write_bucketed(with_year(df) if table == "orders" else df, path, scratch, buckets)
            spark.sql(f"DROP TABLE {scratch}")  # external: its files stay
        else:
            df.write.parquet(path)
    schemas = {table: model.table(table).schema.json() for table in SCHEMAS}
    extents = model.extents or measured(model)
    note = {"name": name, "buckets": buckets, "schemas": schemas, "extents": as_text(extents)}
    number = versions.commit(spark, folder, json.dumps(note))
    if keep is not None:
        for old in versions.prune(spark, folder, keep):
            versions.Folder(spark, f"{folder.rstrip('/')}/tables").remove(json.loads(old)["name"])
    return number


def committed(spark: SparkSession, folder: str) -> dict:
    """The text of the last committed layout."""
    text = versions.latest(spark, folder)
    if text is None:
        raise FileNotFoundError(f"no layout in {folder}")
    return json.loads(text)
