"""Totals of a fact table per attribute of a dimension table.

Two exact plans, for any skew of the key or the attribute; a measured record of the
dimension chooses:

* total by key first, so that a hot key becomes one row per map task, join those
  totals to the dimension, and total again by attribute.
* where the dimension fits a broadcast and many keys share an attribute: join in
  the map tasks, then total by attribute. Only one row per attribute and task is
  shuffled. Without shared attributes this would shuffle as many rows as the
  first plan, and longer ones.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderboard.operators.key_filter import may_match

BROADCAST_LIMIT = "orderboard.broadcast.maxBytes"
DEFAULT_BROADCAST_LIMIT = 64 * 1024 * 1024
# Hash-table cost of one row besides the bytes of its strings.
ROW_OVERHEAD = 64
VALUE_WIDTH = 16
# Keys that must share an attribute, on average, for joining first to pay.
KEYS_PER_GROUP = 4


class Measure(NamedTuple):
    """An aggregate that can be taken in two steps."""

    name: str
    over_rows: Column
    over_totals: Callable[[str], Column]


def total(name: str, value: str | Column) -> Measure:
    return Measure(name, F.sum(value), F.sum)


def row_count(name: str) -> Measure:
    return Measure(name, F.count(F.lit(1)), F.sum)


def non_null_count(name: str, column: str) -> Measure:
    return Measure(name, F.count(column), F.sum)


def largest(name: str, column: str) -> Measure:
    return Measure(name, F.max(column), F.max)


def _from_rows(measures: Sequence[Measure]) -> list[Column]:
    return [m.over_rows.alias(m.name) for m in measures]


def _from_totals(measures: Sequence[Measure]) -> list[Column]:
    return [m.over_totals(m.name).alias(m.name) for m in measures]


class Extent(NamedTuple):
    """What one pass over a dimension's key and attributes tells.

    ``size`` bounds the bytes of a broadcast; -1 where a column's width has no bound.
    """

    size: int
    keys: int
    groups: int

    def joins_first(self, limit: int) -> bool:
        """Whether to broadcast the dimension and join before totalling."""
        return 0 <= self.size <= limit and self.keys >= KEYS_PER_GROUP * max(self.groups, 1)


# What a dimension is taken for that nobody measured: totals come first, and adaptive
# execution broadcasts what turns out to be small.
ASSUMED: Extent | None = None


def broadcast_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BROADCAST_LIMIT, str(DEFAULT_BROADCAST_LIMIT)))


def measure(side: DataFrame, key: str) -> Extent:
    """Measure a dimension's key and attributes, once, with a job.

    Groups, the distinct attributes, are estimated; they only choose between exact
    plans.
    """
    size = f"count(1) * {ROW_OVERHEAD + VALUE_WIDTH * len(side.columns)}"
    bounded = True
    for field in side.schema.fields:
        if isinstance(field.dataType, T.StringType):
            size += f" + coalesce(sum(octet_length(`{field.name}`)), 0)"
        elif not isinstance(field.dataType, (T.NumericType, T.DatetimeType, T.BooleanType)):
            bounded = False
    attributes = ", ".join(f"`{c}`" for c in side.columns if c != key)
    groups = f"approx_count_distinct(xxhash64({attributes}))" if attributes else "1L"
    row = side.selectExpr(f"{size} AS bytes", "count(1) AS keys", f"{groups} AS groups").first()
    return Extent(row["bytes"] if bounded else -1, row["keys"], row["groups"])


def join_then_total(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    by: Sequence[str],
    measures: Sequence[Measure],
) -> DataFrame:
    joined = facts.join(F.broadcast(dimension), key)
    return joined.groupBy(*by).agg(*_from_rows(measures))


def total_then_join(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    by: Sequence[str],
    measures: Sequence[Measure],
) -> DataFrame:
    own = [c for c in by if c not in dimension.columns]
    totals = facts.groupBy(key, *own).agg(*_from_rows(measures))
    return totals.join(dimension, key).groupBy(*by).agg(*_from_totals(measures))


def with_fixed_types(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Decimal totals as decimal(38, scale), so that the plan does not show in the schema."""
    kinds = {f.name: f.dataType for f in totals.schema.fields}
    return totals.withColumns({
        n: F.col(n).cast(T.DecimalType(38, kinds[n].scale)) for n in names if isinstance(kinds[n], T.DecimalType)
    })


def total_by_attributes(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    by: Sequence[str],
    measures: Sequence[Measure],
    within_keys: bool = False,
    filter_keys: bool = False,
    extent: Extent | None = None,
) -> DataFrame:
    """Totals of the facts that have a dimension row, per ``by``.

    ``by`` names attributes of the dimension or columns of the facts. ``extent`` is
    what ``measure`` told of the dimension; building the plan runs no job.
    ``within_keys`` limits the facts to the dimension's key range; where keys grow
    over time the scan then skips most row groups. ``filter_keys`` tests the facts
    that would be shuffled against a bounded filter of the dimension's keys, which
    also serves where keys are scattered.
    """
    narrow = dimension.select(key, *[c for c in by if c in dimension.columns and c != key])
    extent = extent or ASSUMED
    joins_first = extent is not None and extent.joins_first(broadcast_limit(facts))
    if within_keys:
        low, high = (narrow.select(bound(key)).scalar() for bound in (F.min, F.max))
        facts = facts.filter(F.col(key).between(low, high))
    if filter_keys and not joins_first:
        facts = may_match(facts, narrow, key)
    plan = join_then_total if joins_first else total_then_join
    return with_fixed_types(plan(facts, narrow, key, by, measures), [m.name for m in measures])
