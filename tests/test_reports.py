"""Hand-computed answers on the small model, by both plans of each join."""

from __future__ import annotations

from decimal import Decimal

import pytest

from orderboard.functions.dates import in_year, month_name
from orderboard.operators import dimensions
from orderboard.operators.shares import share_of_total
from orderboard.plans import charts, kpis, reports, rollups

D = Decimal


@pytest.fixture(params=["join first", "total first"])
def m(small, request, monkeypatch):
    extent = dimensions.Extent(0, 100, 1) if request.param == "join first" else None
    monkeypatch.setattr(dimensions, "ASSUMED", extent)
    return small


def rows(df):
    return [tuple(r) for r in df.collect()]


def sales(m, *by):
    return rollups.product_sales(m.order_lines, m.products, by or ("product_name",))


def activity(m):
    return rollups.customer_activity(m.orders, m.customers)


def customers_in(m, year):
    orders = in_year(m.orders, "order_date", year)
    return reports.orders_per_customer(rollups.customer_activity(orders, m.customers))


def lines_per_product(m):
    return reports.order_lines_per_product(sales(m), m.products)


def test_products_are_grouped_by_name_and_ties_go_by_name(m):
    assert rows(reports.top_products_by_quantity(sales(m))) == [
        ("Pan", D("6.00"), 1), ("Te", D("6.00"), 2), (None, D("1.00"), 3),
    ]
    assert rows(reports.top_products_by_quantity(sales(m), n=1)) == [("Pan", D("6.00"), 1)]


def test_top_and_bottom_by_lines_leave_out_unsold(m):
    assert rows(reports.top_products_by_lines(sales(m))) == [
        ("Te", 3, 1), ("Pan", 2, 2), (None, 1, 3),
    ]
    assert rows(reports.bottom_products_by_lines(sales(m), n=2)) == [(None, 1, 1), ("Pan", 2, 2)]


def test_unsold_products_have_zero_lines(m):
    # Pan's second line has no order id, so it does not count.
    assert dict(rows(lines_per_product(m))) == {"Te": 3, "Pan": 1, "Sal": 0, None: 1}


def test_top_and_bottom_repeat_rows_when_groups_are_few(m):
    assert rows(charts.top_bottom_products(lines_per_product(m))) == [
        ("Te", 3, "top"), ("Pan", 1, "top"), (None, 1, "top"), ("Sal", 0, "top"),
        ("Te", 3, "bottom"), ("Pan", 1, "bottom"), (None, 1, "bottom"), ("Sal", 0, "bottom"),
    ]
    assert rows(charts.top_bottom_products(lines_per_product(m), n=1)) == [
        ("Te", 3, "top"), ("Sal", 0, "bottom"),
    ]


def test_customers(m):
    assert rows(reports.orders_per_customer(activity(m))) == [
        ("Ana", 3), ("Beto", 1), ("Caro", 1), (None, 1),
    ]
    assert rows(customers_in(m, 2021)) == [("Ana", 1), ("Beto", 1), ("Caro", 1), (None, 1)]
    assert rows(charts.top_customers(customers_in(m, 2021), n=2)) == [("Ana", 1), ("Beto", 1)]
    assert rows(charts.top_bottom_customers(customers_in(m, 2021), n=1)) == [
        ("Ana", 1, "top"), (None, 1, "bottom"),
    ]


def test_unknown_payment_codes_keep_their_own_rows(m):
    calendar = rollups.order_calendar(m.orders, "payment_code")
    assert sorted(rows(reports.orders_per_payment_method(calendar))) == [
        ("CREDITO", 1), ("EFECTIVO", 3), ("OTRO", 1), ("OTRO", 1), ("OTRO", 1),
    ]


def test_years_and_months(m):
    dated = rollups.with_periods(m.orders)
    assert rows(reports.orders_per_year(rollups.order_calendar(dated, "order_year"))) == [
        ("2020", 1), ("2021", 5), ("2022", 1),
    ]
    in_2021 = rollups.order_calendar(in_year(dated, "order_date", 2021), "month_no")
    assert rows(charts.orders_per_month(in_2021)) == [
        (1, "January", 2), (3, "March", 2), (12, "December", 1),
    ]


def test_revenue_per_month_counts_lines_without_a_product(m):
    assert rows(reports.revenue_per_month(m.order_lines, m.orders, 2021)) == [
        (1, "January", D("31.5000")), (3, "March", D("52.5000")), (12, "December", D("12.0000")),
    ]
    assert rows(reports.revenue_per_month(m.order_lines, m.orders, 1999)) == []


def test_categories_and_suppliers(m):
    by_category = reports.quantity_per_category(sales(m, "category_id"), m.categories)
    assert dict(rows(by_category)) == {"Bebidas": D("6.00"), "Carnes": D("7.00")}
    assert rows(share_of_total(by_category.orderBy("category_name"), "quantity_sold")) == [
        ("Bebidas", D("6.00"), 46.2, "46.2%"), ("Carnes", D("7.00"), 53.8, "53.8%"),
    ]
    per_supplier = rollups.supplier_products(m.products, m.suppliers)
    assert rows(reports.products_per_supplier(per_supplier)) == [("Norte", 2), ("Sur", 2)]
    assert rows(charts.top_suppliers(reports.products_per_supplier(per_supplier), 1)) == [("Norte", 2)]


def board(m):
    return kpis.kpi_board(
        rollups.order_calendar(m.orders),
        activity(m),
        sales(m),
        kpis.total_revenue(m.order_lines),
        rollups.supplier_products(m.products, m.suppliers),
        m.products,
        m.customers,
        m.suppliers,
    )


def single_cards(m):
    """Each card on its own, as text."""
    per_supplier = rollups.supplier_products(m.products, m.suppliers)
    return {
        "order_count": kpis.order_count(m.orders),
        "best_selling_product": kpis.best_selling_product(sales(m)),
        "top_customer": kpis.top_customer(activity(m)),
        "total_revenue": kpis.total_revenue(m.order_lines),
        "avg_price": kpis.avg_price(m.products),
        "top_supplier": kpis.top_supplier(per_supplier),
        "max_freight_customer": kpis.max_freight_customer(activity(m)),
        "customer_count": kpis.customer_count(m.customers),
        "supplier_count": kpis.supplier_count(m.suppliers),
        "latest_order": kpis.latest_order(m.orders),
        "most_stock": kpis.most_stock(m.products),
        "least_stock": kpis.least_stock(m.products),
        "orders_without_rep": kpis.orders_without_rep(m.orders),
    }


def test_cards(m):
    cards = {k: rows(df)[0][0] for k, df in single_cards(m).items()}
    assert cards.pop("total_revenue") == D("124.0000")
    assert cards.pop("avg_price") == D("5.00")
    assert cards == {
        "order_count": 7,
        "best_selling_product": "Pan",
        "top_customer": "Ana",
        "top_supplier": "Norte",
        "max_freight_customer": "Caro",  # all NULL sorts first
        "customer_count": 5,
        "supplier_count": 3,
        "latest_order": "01/01/2022",
        "most_stock": "Sal",  # NULL stock sorts first when descending
        "least_stock": "Pan",
        "orders_without_rep": 2,
    }
    assert sorted(rows(kpis.priciest_product(m.products))) == [("Pan",), ("Te",)]


def test_board_agrees_with_single_cards(m):
    shown = dict(rows(board(m)))
    assert len(shown) == 14
    assert shown.pop("priciest_product") == "Pan"
    assert shown.pop("avg_price") == "5.00"
    for name, df in single_cards(m).items():
        if name in shown:
            assert shown[name] == str(rows(df)[0][0]), name


def test_empty_tables(empty):
    m = empty
    assert rows(kpis.order_count(m.orders)) == [(0,)]
    assert rows(kpis.total_revenue(m.order_lines)) == [(None,)]
    assert rows(kpis.avg_price(m.products)) == [(None,)]
    assert rows(kpis.latest_order(m.orders)) == [(None,)]
    for df in (
        kpis.priciest_product(m.products),
        kpis.best_selling_product(sales(m)),
        kpis.most_stock(m.products),
        reports.orders_per_customer(activity(m)),
        reports.revenue_per_month(m.order_lines, m.orders, 2021),
        charts.top_bottom_products(lines_per_product(m)),
        share_of_total(customers_in(m, 2021), "order_count"),
    ):
        assert rows(df) == []
    shown = dict(rows(board(m)))
    assert {k for k, v in shown.items() if v == "0"} == {
        "order_count", "customer_count", "supplier_count", "orders_without_rep",
    }
    assert sum(v is None for v in shown.values()) == 10


def test_month_name_padding(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(5,), (9,)], "m int")
    assert rows(df.select(month_name(F.col("m"), padded=True))) == [("May      ",), ("September",)]
