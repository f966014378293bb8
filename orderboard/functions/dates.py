"""Year filters and the date texts the reports show."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: month names are blank-padded to the longest English one.
MONTH_NAME_WIDTH = 9
# Year columns of date columns.
YEAR_COLUMNS = {"order_date": "order_year"}


def in_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of one calendar year.

    A half-open range on the bare column reaches the scan and prunes date
    partitions; ``year(column) = y`` would do neither. Where the frame has the
    column's year, as tables partitioned by it do, that prunes too.
    """
    day = F.col(column)
    within = (day >= F.lit(datetime.date(year, 1, 1))) & (day < F.lit(datetime.date(year + 1, 1, 1)))
    if YEAR_COLUMNS.get(column) in df.columns:
        within &= F.col(YEAR_COLUMNS[column]) == year
    return df.filter(within)


def day_text(date: Column) -> Column:
    return F.date_format(date, "dd/MM/yyyy")


def month_name(month_no: Column, padded: bool = False) -> Column:
    """English name of a month number.

    Group on the number and name it afterwards: the number sorts in calendar
    order and the text is formatted once per group.
    """
    name = F.date_format(F.make_date(F.lit(2000), month_no, F.lit(1)), "MMMM")
    return F.rpad(name, MONTH_NAME_WIDTH, " ") if padded else name
