"""A small order model with the cases the generated tables do not contain."""

from __future__ import annotations

import contextlib
import datetime
import io
from decimal import Decimal

from orderboard.model import SCHEMAS, OrderModel
from orderboard.sources.files import read_order_model

D = Decimal


def day(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


ROWS = {
    "customers": [(1, "Ana"), (2, "Beto"), (3, "Caro"), (4, "Ana"), (5, None)],
    "suppliers": [(1, "Norte"), (2, "Sur"), (3, "Norte")],
    "categories": [(1, "Bebidas"), (2, "Carnes"), (3, "Bebidas")],
    # Two products named Te, one never sold, one without a name.
    "products": [
        (10, "Te", D("4.00"), 5, 1, 1),
        (11, "Te", D("9.00"), 50, 2, 3),
        (12, "Pan", D("9.00"), 1, 3, 2),
        (13, "Sal", D("1.01"), None, None, None),
        (14, None, D("2.00"), 7, 2, 2),
    ],
    # Caro's freights are all NULL; five payment codes, two of them known.
    "orders": [
        (100, 1, 7, day("2020-01-15"), "E", D("5.00")),
        (101, 1, None, day("2021-01-20"), "C", D("7.00")),
        (102, 2, 8, day("2021-03-01"), "D", D("9.00")),
        (103, 3, None, day("2021-12-31"), "T", None),
        (104, 4, 7, day("2022-01-01"), None, D("2.00")),
        (105, None, 7, day("2021-01-02"), "E", D("1.00")),
        (106, 5, 7, day("2021-03-05"), "E", D("1.00")),
    ],
    # Te (both) and Pan tie at 6; one line has no product, one an unknown one.
    "order_lines": [
        (100, 10, D("2.00"), D("4.00")),
        (101, 10, D("1.00"), D("4.50")),
        (101, 11, D("3.00"), D("9.00")),
        (102, 12, D("6.00"), D("8.75")),
        (103, 14, D("1.00"), D("2.00")),
        (103, None, D("1.00"), D("10.00")),
        (104, 99, D("1.00"), D("20.00")),
        (None, 12, D("0.00"), D("1.00")),
    ],
}


def stored_model(spark, folder: str, rows: dict) -> OrderModel:
    for table, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(table, []), schema)
        df.coalesce(1).write.parquet(f"{folder}/{table}")
    return read_order_model(spark, folder)


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
