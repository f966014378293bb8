"""The canonical order model: table schemas and the bundle reports work on."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Table = DataFrame | Callable[[], DataFrame]

MONEY = T.DecimalType(12, 2)

SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("employee_id", T.LongType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("payment_code", T.StringType()),
        T.StructField("freight", MONEY),
    ]),
    "order_lines": T.StructType([
        T.StructField("order_id", T.LongType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("quantity", MONEY),
        T.StructField("unit_price", MONEY),
    ]),
    "products": T.StructType([
        T.StructField("product_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("unit_price", MONEY),
        T.StructField("units_in_stock", T.LongType()),
        T.StructField("supplier_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
    ]),
    "customers": T.StructType([
        T.StructField("customer_id", T.LongType()),
        T.StructField("company_name", T.StringType()),
    ]),
    "suppliers": T.StructType([
        T.StructField("supplier_id", T.LongType()),
        T.StructField("company_name", T.StringType()),
    ]),
    "categories": T.StructType([
        T.StructField("category_id", T.LongType()),
        T.StructField("category_name", T.StringType()),
    ]),
}


# Types a source may use instead of the schema's; they are read as they are.
ALSO_READ: dict[str, tuple[type[T.DataType], ...]] = {
    "order_date": (T.TimestampType, T.TimestampNTZType),
    "employee_id": (T.StringType,),
    "category_id": (T.StringType,),
}
# Decimal digits that hold every value of an integer type.
DIGITS: dict[type[T.DataType], int] = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
# Decimal digits whose every value a long holds.
LONG_DIGITS = 18


class LossyColumn(TypeError):
    """A column whose type could change a value on the way into the model."""


def casts_exactly(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of ``source`` is a value of ``target``."""
    if source == target:
        return True
    whole = DIGITS.get(type(source))
    if isinstance(target, T.LongType):
        if isinstance(source, T.DecimalType):
            return source.scale == 0 and source.precision <= LONG_DIGITS
        return whole is not None
    if isinstance(target, T.DecimalType):
        room = target.precision - target.scale
        if isinstance(source, T.DecimalType):
            return source.scale <= target.scale and source.precision - source.scale <= room
        return whole is not None and whole <= room
    if isinstance(target, T.StringType):
        return isinstance(source, (T.CharType, T.VarcharType))
    return False


def _tested(name: str, source: T.DataType, target: T.DataType) -> Column:
    """The cast value; one that would change fails the job and names the column."""
    value = F.col(f"`{name}`")
    cast = value.try_cast(target)
    back = cast.try_cast(T.DecimalType(38, 18)) == value.try_cast(T.DecimalType(38, 18))
    same = back if isinstance(source, T.NumericType) else cast.try_cast(source) == value
    failed = F.raise_error(F.concat(F.lit(f"column {name}: "), value.cast("string"), F.lit(f" is no {target.simpleString()}")))
    return F.when(value.isNull() | F.coalesce(same, F.lit(False)), cast).otherwise(failed.cast(target))


def reconciled(df: DataFrame, table: str, tested: Collection[str] = ()) -> DataFrame:
    """``df`` with the model's columns and types.

    A type that holds values which the model's cannot, such as a double price or an id
    of 38 digits, is refused by column when the table is opened. Columns in ``tested``
    are let in by value instead: the job fails at a value that the cast would change.
    """
    require_columns(df, table, SCHEMAS[table].fieldNames())
    given = {f.name.lower(): f for f in df.schema.fields}
    columns, refused = [], []
    for field in SCHEMAS[table].fields:
        source = given[field.name.lower()]
        value = F.col(f"`{source.name}`")
        if casts_exactly(source.dataType, field.dataType):
            columns.append(value.cast(field.dataType).alias(field.name))
        elif isinstance(source.dataType, ALSO_READ.get(field.name, ())):
            columns.append(value.alias(field.name))
        elif field.name in tested:
            columns.append(_tested(source.name, source.dataType, field.dataType).alias(field.name))
        else:
            refused.append(f"{field.name} is {source.dataType.simpleString()}, not {field.dataType.simpleString()}")
    if refused:
        raise LossyColumn(f"table {table!r}: " + "; ".join(refused))
    return df.select(columns)


def require_columns(df: DataFrame, table: str, columns: Iterable[str]) -> None:
    """Fail early, naming what a source lacks, instead of deep inside a plan."""
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise ValueError(f"table {table!r} lacks columns {missing}; it has {df.columns}")


class OrderModel:
    """Six related tables, each a frame or a function that reads it.

    A table is read when a report first asks for it. Columns are checked by name
    here; sources whose types are not declared pass through ``reconciled``.

    ``extents`` is the measured record of the dimensions (``operators/extents.py``);
    ``by_order`` tells that orders and lines are bucketed by ``order_id``.
    """

    def __init__(self, **tables: Table) -> None:
        if set(tables) != set(SCHEMAS):
            raise ValueError(f"expected the tables {sorted(SCHEMAS)}, got {sorted(tables)}")
        self._tables = tables
        self._frames: dict[str, DataFrame] = {}
        self.extents: Mapping[tuple[str, tuple[str, ...]], Any] = {}
        self.by_order = False

    def extent(self, table: str, by: Sequence[str]) -> Any:
        """The measured extent of the table's key and these attributes; None if unknown."""
        return self.extents.get((table, tuple(by)))

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            source = self._tables[name]
            df = source if isinstance(source, DataFrame) else source()
            require_columns(df, name, SCHEMAS[name].fieldNames())
            self._frames[name] = df
        return self._frames[name]

    @property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @property
    def order_lines(self) -> DataFrame:
        return self.table("order_lines")

    @property
    def products(self) -> DataFrame:
        return self.table("products")

    @property
    def customers(self) -> DataFrame:
        return self.table("customers")

    @property
    def suppliers(self) -> DataFrame:
        return self.table("suppliers")

    @property
    def categories(self) -> DataFrame:
        return self.table("categories")
