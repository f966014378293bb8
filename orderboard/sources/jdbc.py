"""Tables and statements from a relational database.

Connection options (``url``, ``user``, ``password``, ``driver``) come from the
caller's configuration.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

FETCH_SIZE = 10_000
# Rows that one task may fetch.
MAX_ROWS_OF_ONE_TASK = 1_000_000

Key = int | Decimal | str | datetime.date | datetime.datetime


def table_options(
    connection: Mapping[str, str],
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
) -> dict[str, str]:
    """Options of a read split into ranges of ``partition_column``.

    The bounds only place the cuts: rows beyond them, and NULLs, are read too.
    """
    if partitions < 1:
        raise ValueError("partitions must be at least 1")
    return {
        "fetchsize": str(FETCH_SIZE),
        **connection,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def query_options(connection: Mapping[str, str], query: str) -> dict[str, str]:
    """Options of one statement that the database runs, such as an aggregate."""
    return {"fetchsize": str(FETCH_SIZE), **connection, "query": query}


def read_table(
    spark: SparkSession,
    connection: Mapping[str, str],
    table: str,
    partition_column: str,
    lower: int | str,
    upper: int | str,
    partitions: int,
) -> DataFrame:
    options = table_options(connection, table, partition_column, lower, upper, partitions)
    return spark.read.format("jdbc").options(**options).load()


class TooLarge(ValueError):
    """A result that one task should not fetch."""


def count_statement(query: str) -> str:
    return f"SELECT COUNT(*) AS row_total FROM ({query}) q"


def read_query(
    spark: SparkSession, connection: Mapping[str, str], query: str, max_rows: int = MAX_ROWS_OF_ONE_TASK
) -> DataFrame:
    """Result of one statement, fetched by one task.

    The database counts the rows first; more than ``max_rows`` are refused. Use
    ``read_query_in_parts`` for those.
    """
    reader = spark.read.format("jdbc")
    rows = int(reader.options(**query_options(connection, count_statement(query))).load().first()[0])
    if rows > max_rows:
        raise TooLarge(f"{rows} rows are more than {max_rows} for one task; read the statement in parts")
    return spark.read.format("jdbc").options(**query_options(connection, query)).load()


def bounds_statement(source: str, column: str, parts: int) -> str:
    """A statement that the database runs to cut ``source`` into parts of equally many rows.

    ``source`` is a table or a statement in brackets. One row for each part: its number
    from 1, its smallest key and its rows. A key that fills several parts begins each.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    return (
        f"SELECT part_no, MIN(part_key) AS low, COUNT(*) AS part_rows FROM ("
        f"SELECT {column} AS part_key, NTILE({parts}) OVER (ORDER BY {column}) AS part_no"
        f" FROM {source} s WHERE {column} IS NOT NULL) t GROUP BY part_no ORDER BY part_no"
    )


def literal(key: Key) -> str:
    """A key as SQL text."""
    if isinstance(key, datetime.datetime):
        return f"TIMESTAMP '{key.isoformat(sep=' ')}'"
    if isinstance(key, datetime.date):
        return f"DATE '{key.isoformat()}'"
    if isinstance(key, str):
        return "'" + key.replace("'", "''") + "'"
    if isinstance(key, bool) or not isinstance(key, (int, Decimal)):
        raise TypeError(f"no key of a range: {key!r}")
    return str(key)


def range_predicates(column: str, lows: Sequence[Key], within: str | None = None) -> list[str]:
    """Conditions that share out all rows, each row to one of them.

    ``lows`` are the smallest keys of the parts in order. A key that repeats fills
    parts of its own: it gets a condition apart, and as many of them by the remainder
    of ``within``, a column of whole numbers, if that is given. Rows without a key are
    a part, and so are those below the first low, should there be new ones.
    """
    if not lows:
        return ["1 = 1"]
    cuts = list(dict.fromkeys(lows))
    parts = [f"{column} IS NULL", f"{column} < {literal(cuts[0])}"]
    for low, following in zip(cuts, [*cuts[1:], None], strict=True):
        above = "" if following is None else f" AND {column} < {literal(following)}"
        times = lows.count(low)
        if times == 1:
            parts.append(f"{column} >= {literal(low)}{above}")
            continue
        same = f"{column} = {literal(low)}"
        if within is None:
            parts.append(same)
        else:
            parts += [f"{same} AND MOD(ABS({within}), {times}) = {i}" for i in range(times)]
            parts.append(f"{same} AND {within} IS NULL")
        parts.append(f"{column} > {literal(low)}{above}")
    return parts


def balanced_predicates(
    spark: SparkSession,
    connection: Mapping[str, str],
    source: str,
    column: str,
    parts: int,
    within: str | None = None,
) -> list[str]:
    """Conditions of nearly equal parts of a table or bracketed statement.

    The bounds are quantiles that the database finds with one statement of ``parts``
    rows, so a skewed key or one with gaps is cut where its rows are.
    """
    options = query_options(connection, bounds_statement(source, column, parts))
    found = spark.read.format("jdbc").options(**options).load().collect()  # ``parts`` rows
    return range_predicates(column, [r[1] for r in sorted(found, key=lambda r: r[0])], within)


def _read_parts(
    spark: SparkSession, connection: Mapping[str, str], source: str, predicates: list[str]
) -> DataFrame:
    properties = {"fetchsize": str(FETCH_SIZE), **{k: v for k, v in connection.items() if k != "url"}}
    return spark.read.jdbc(connection["url"], source, predicates=predicates, properties=properties)


def read_table_balanced(
    spark: SparkSession,
    connection: Mapping[str, str],
    table: str,
    column: str,
    parts: int,
    within: str | None = None,
) -> DataFrame:
    """A table read by one task for each of about ``parts`` equal shares of its rows."""
    found = balanced_predicates(spark, connection, table, column, parts, within)
    return _read_parts(spark, connection, table, found)


def read_query_in_parts(
    spark: SparkSession,
    connection: Mapping[str, str],
    query: str,
    column: str,
    parts: int,
    within: str | None = None,
) -> DataFrame:
    """A statement's result by one task for each share of its rows.

    The database runs the statement once for each part; ``column`` should have an index.
    """
    found = balanced_predicates(spark, connection, f"({query})", column, parts, within)
    return _read_parts(spark, connection, f"({query}) q", found)
