"""The stored layout: what it holds, what a report of it reads and moves."""

from __future__ import annotations

import re

import pytest
from fixtures import plan_of

from orderboard.model import SCHEMAS
from orderboard.operators.dimensions import BROADCAST_LIMIT
from orderboard.operators.extents import as_text, from_text, measured
from orderboard.plans import reports, suite
from orderboard.scratch import shared_folder
from orderboard.sinks import versions
from orderboard.sinks.layout import write_layout
from orderboard.sources import layout, star_schema

FOLDER = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stored(spark):
    folder = shared_folder(spark, "layout")
    write_layout(star_schema.order_model(spark, FOLDER), folder, 4)
    return folder


def test_the_model_is_read_back_whole(spark, small, empty):
    for model in (small, empty):
        folder = shared_folder(spark, "layout")
        write_layout(model, folder, 3)
        back = layout.order_model(spark, folder)
        for name in SCHEMAS:
            columns = SCHEMAS[name].fieldNames()
            assert rows(back.table(name).select(columns)) == rows(model.table(name))
            assert back.table(name).select(columns).schema == model.table(name).schema
        assert back.by_order and back.extents == measured(model)


def test_reports_of_the_layout_equal_those_of_the_source(spark, stored):
    source, model = star_schema.order_model(spark, FOLDER), layout.order_model(spark, stored)
    built = [suite.order_reports(spark, m, 1998, 1997, star_schema.PRIORITY_LABELS) for m in (source, model)]
    for name in ("revenue_per_month", "orders_per_customer_in_year", "orders_per_month", "quantity_per_category"):
        assert rows(built[1][name]()) == rows(built[0][name]())


def test_one_year_is_read_and_no_line_moves(spark, stored):
    settings = {BROADCAST_LIMIT: "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        model = layout.order_model(spark, stored)
        df = reports.revenue_per_month(model.order_lines, model.orders, 1998, not model.by_order)
        plan = plan_of(df)
    finally:
        for key in settings:
            spark.conf.unset(key)
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["month_no"]
    assert re.search(r"PartitionFilters: \[[^\]]*order_year#\d+ = 1998", plan)
    source = star_schema.order_model(spark, FOLDER)
    assert rows(df) == rows(reports.revenue_per_month(source.order_lines, source.orders, 1998))


def test_one_file_for_each_bucket_and_year(spark, stored):
    tables = versions.Folder(spark, stored + "/tables")
    (name,) = tables.names()
    years = [n for n in tables.names(f"{name}/orders") if n.startswith("order_year=")]
    assert len(years) == 7
    for year in years:
        files = [f for f in tables.names(f"{name}/orders/{year}") if f.endswith(".parquet")]
        assert len(files) == 4


def test_a_failed_layout_leaves_the_last_one(spark, small):
    folder = shared_folder(spark, "layout")
    assert write_layout(small, folder, 2, keep=1) == 1
    broken = type(small)(**{t: small.table(t) for t in SCHEMAS})
    broken._frames["categories"] = small.categories.selectExpr("category_id", "raise_error('gone') AS category_name")
    with pytest.raises(Exception, match="gone"):
        write_layout(broken, folder, 2)
    assert rows(layout.order_model(spark, folder).suppliers) == rows(small.suppliers)
    assert write_layout(small, folder, 2, keep=1) == 2
    kept = layout.committed(spark, folder)["name"]
    assert kept in versions.Folder(spark, folder).names("tables") and versions.Folder(spark, folder).names("versions") == ["000000000002"]
    with pytest.raises(FileNotFoundError):
        layout.order_model(spark, folder + "/none")


def test_the_record_as_text(small):
    found = measured(small)
    assert from_text(as_text(found)) == found
    assert found["products", ("product_name",)].keys == 5
    assert found["orders", ("order_date",)].keys == 5  # of 2021
