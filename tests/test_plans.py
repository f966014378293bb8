"""The physical plans reports are meant to have."""

from __future__ import annotations

import re

import pytest
from fixtures import plan_of

import __spark_entry__ as contract
from orderboard.functions.dates import in_year
from orderboard.model import SCHEMAS
from orderboard.operators.dimensions import BROADCAST_LIMIT
from orderboard.plans import reports, rollups, suite
from orderboard.sources import star_schema

FOLDER = "/root/testdata/sf0.01"


def query_plan(spark, name) -> str:
    return plan_of(contract.queries()[name](spark, FOLDER))


def scans(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)


@pytest.fixture
def large_dimensions(spark):
    """As if no dimension fitted a broadcast."""
    settings = {BROADCAST_LIMIT: "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_small_dimension_needs_no_fact_shuffle(spark):
    plan = query_plan(spark, "top10_products_by_quantity")
    assert plan.count("BroadcastHashJoin") == 1
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["product_name"]
    assert "TakeOrderedAndProject(limit=10" in plan
    assert scans(plan) == [
        "struct<l_partkey:bigint,l_quantity:double>",
        "struct<p_partkey:bigint,p_name:string>",
    ]


def test_names_of_their_own_are_joined_after_totalling(spark):
    plan = query_plan(spark, "orders_per_customer")
    join = plan.index("Join")
    assert join < plan.index("HashAggregate(keys=[customer_id") < plan.index("o_custkey")


def test_large_dimension_meets_totals_not_rows(spark, large_dimensions):
    plan = query_plan(spark, "top10_products_by_quantity")
    assert "BroadcastHashJoin" not in plan
    # Lines: partial totals, exchange on the key, final totals; the join adds no exchange.
    assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == [
        "product_id", "product_id", "product_name",
    ]
    partial = plan.index("partial_sum(quantity#")
    assert plan.index("SortMergeJoin") < partial < plan.index("l_quantity")


def test_revenue_joins_in_the_partitioning_of_the_totals(spark, large_dimensions):
    plan = query_plan(spark, "revenue_per_month")
    keys = re.findall(r"Exchange hashpartitioning\((\w+)#", plan)
    assert [k for k in sorted(keys) if k in ("month_no", "order_id")] == ["month_no", "order_id", "order_id"]
    # The bounds are read when the query runs.
    for side in (">=", "<="):
        assert re.search(rf"l_orderkey#\d+L? {side} .*?[Ss]ubquery", plan)


def test_lines_are_filtered_before_any_exchange(spark, large_dimensions):
    """From the lines' scan up: the filter's join, partial totals, only then an exchange."""
    model = star_schema.order_model(spark, FOLDER)
    df = reports.revenue_per_month(model.order_lines, model.orders, 1998)
    plan = plan_of(df)
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "l_orderkey" in x)

    def depth(line):
        return len(line) - len(line.lstrip(" :+-"))

    above, level = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            above.append(line.strip(" :+-"))
    names = [re.match(r"\w+", x).group() for x in above if re.match(r"\w+", x)]
    first = names.index("BroadcastHashJoin")
    assert "LeftSemi" in above[first] and "getbit" in above[first]
    assert first < names.index("HashAggregate") < names.index("Exchange") < names.index("SortMergeJoin")
    unfiltered = reports.revenue_per_month(model.order_lines, model.orders, 1998, filter_lines=False)
    assert rows_of(df) == rows_of(unfiltered)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_building_reports_runs_no_job(spark):
    model = star_schema.order_model(spark, FOLDER)
    employees = star_schema.employees(spark, FOLDER)
    for table in SCHEMAS:
        model.table(table)
    contexts = spark.sparkContext
    contexts.setJobGroup("building", "building")
    try:
        for name, build in contract.queries().items():
            if name not in contract._llm_queries() and name not in ("src_csv_employees", "sink_report_roundtrip", "suite_status"):
                build(spark, FOLDER)
        built = suite.order_reports(spark, model, 1998, 1997) | suite.hr_reports(employees)
        for name in ("revenue_per_month", "hr_top4_jobs"):  # those without a stored rollup
            built[name]()
        assert contexts.statusTracker().getJobIdsForGroup("building") == []
    finally:
        contexts.setLocalProperty("spark.jobGroup.id", None)


def test_year_is_a_pushed_range(spark):
    model = star_schema.order_model(spark, FOLDER)
    plan = plan_of(in_year(model.orders, "order_date", 1998).select("order_id"))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01" in plan
    assert "LessThan(o_orderdate,1999-01-01" in plan


def test_supplier_of_products_is_read_only_when_asked(spark):
    assert "l_suppkey" not in query_plan(spark, "kpi_avg_price")
    assert "l_suppkey" in query_plan(spark, "products_per_supplier")


def test_highest_price_is_a_subquery_the_scan_sees(spark):
    plan = query_plan(spark, "kpi_priciest_product")
    assert "Subquery" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["share_quantity_per_category", "top_bottom5_customers"])
def test_two_reads_of_a_grouping_shuffle_it_once(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    df.collect()
    plan = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_bucketed_tables_meet_without_a_shuffle(spark, large_dimensions):
    model = star_schema.order_model(spark, FOLDER)
    for table in ("orders", "order_lines"):
        model.table(table).write.mode("overwrite").bucketBy(8, "order_id").sortBy(
            "order_id"
        ).saveAsTable(f"bucketed_{table}")
    plan = plan_of(
        reports.revenue_per_month(
            spark.table("bucketed_order_lines"), spark.table("bucketed_orders"), 1998, filter_lines=False
        )
    )
    assert re.findall(r"Exchange hashpartitioning\((\w+)#", plan) == ["month_no"]


def test_stored_rollup_is_regrouped_without_a_second_scan_column(spark):
    model = star_schema.order_model(spark, FOLDER)
    fine = rollups.product_sales(model.order_lines, model.products, ["product_name", "category_id"])
    coarse = rollups.product_sales(model.order_lines, model.products)
    by_name = [reports.top_products_by_lines(s).collect() for s in (fine, coarse)]
    assert by_name[0] == by_name[1]
