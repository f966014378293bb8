"""Reading tables and storing intermediate ones."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderboard.scratch import shared_folder

# ASCII white space as the contracts define it, for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Spark's own setting: a query's shuffle files go when the query has ended.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# The folder of each stored table.
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files behind.

    Spark keeps them otherwise until the driver collects garbage. What is read
    later is the written table, so nothing needs them; while the write runs,
    lost ones are made again as always.
    """
    before = spark.conf.get(REMOVE_SHUFFLES, None)
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(REMOVE_SHUFFLES)
        else:
            spark.conf.set(REMOVE_SHUFFLES, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    What builds on it reads a table: a lost executor repeats a read, not the
    work behind it, and a join has an exchange that can be split on both sides.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    with shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def removed(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more.

    What was made of them must be stored itself; a lost executor then repeats a read
    of that and never comes back to them. A stage that adaptive execution gave up, as
    another side of its join was empty, may still be reading; it fails to no effect.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(table))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{name}`") for name in df.columns])
