"""Where intermediate tables go: a folder that every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    Where that is unset it is under the warehouse, which executors share too.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if base.startswith("file:") and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share, not {base}")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
