"""One Parquet dataset per report and run; readers follow the last committed version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderboard.sinks import versions
from orderboard.sources.files import read_parquet


def report_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def write_report(report: DataFrame, folder: str, name: str, keep: int | None = None) -> int:
    """Write a new run of this report, commit it as the next version, return its number.

    A run that fails commits nothing and leaves the last good report alone. With
    ``keep`` only that many versions and their runs stay; a reader that started on an
    older one may lose its files.
    """
    path, run = report_path(folder, name), uuid.uuid4().hex
    spark = report.sparkSession
    report.write.parquet(f"{path}/runs/{run}")
    number = versions.commit(spark, path, run)
    if keep is not None:
        for old in versions.prune(spark, path, keep):
            versions.Folder(spark, f"{path}/runs").remove(old)
    return number


def has_report(spark: SparkSession, folder: str, name: str) -> bool:
    return versions.latest(spark, report_path(folder, name)) is not None


def read_report(
    spark: SparkSession, folder: str, name: str, schema: T.StructType | None = None
) -> DataFrame:
    path = report_path(folder, name)
    run = versions.latest(spark, path)
    if run is None:
        raise FileNotFoundError(f"no report {name!r} in {folder}")
    return read_parquet(spark, f"{path}/runs/{run}", schema)
