"""Run every report as one batch job.

The reports share four stored rollups, so a run scans order lines and orders a few
times however many reports it writes. Rollups are tables in the shared folder: losing
an executor does not repeat the scans.

A run has a name. Its status table is committed after the reports; a rerun of that
name repeats only what failed, with the rollups the first run left, and rollups are
removed when every report is written.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderboard.functions.labels import OTHER_PAYMENT, PAYMENT_LABELS
from orderboard.model import OrderModel
from orderboard.operators.shares import share_of_total
from orderboard.plans import charts, hr, kpis, reports, rollups
from orderboard.scratch import shared_folder
from orderboard.sinks import versions
from orderboard.sinks.reports import has_report, read_report, write_report

Report = Callable[[], DataFrame]

STATUS_TABLE = "_status"
STATUS = T.StructType([
    T.StructField("report", T.StringType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("rows", T.LongType()),
    T.StructField("error", T.StringType()),
])


class StoredTable:
    """A rollup that is written when the first report asks for it.

    One that an earlier run of the same folder wrote is used as it is. If building
    fails, every report that needs it fails with the same error instead of repeating
    the work.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, build: Report) -> None:
        self._spark, self._folder, self._name, self._build = spark, folder, name, build
        self._lock = Lock()
        self._schema: T.StructType | None = None
        self._error: Exception | None = None

    def __call__(self) -> DataFrame:
        with self._lock:
            if self._error is not None:
                raise self._error
            if self._schema is None:
                try:
                    rollup = self._build()
                    if not has_report(self._spark, self._folder, self._name):
                        write_report(rollup, self._folder, self._name)
                except Exception as error:
                    self._error = error
                    raise
                self._schema = rollup.schema
        return read_report(self._spark, self._folder, self._name, self._schema)


def order_reports(
    spark: SparkSession,
    model: OrderModel,
    year: int,
    month_year: int,
    labels: Mapping[str, str] = PAYMENT_LABELS,
    default_label: str = OTHER_PAYMENT,
    top: int = 10,
    ends: int = 5,
    slices: int = 7,
    rollup_folder: str | None = None,
) -> dict[str, Report]:
    """All order reports by name; ``month_year`` is the year of orders per month.

    ``top`` rows of the ranked reports, ``ends`` at each end of the two-ended ones and
    ``slices`` of the shares are shown; names keep the numbers of the defaults.
    ``rollup_folder`` names the rollups' place, so that a rerun finds them.
    """
    stored = partial(StoredTable, spark, rollup_folder or shared_folder(spark, "rollups"))
    by_product, by_name = ["product_name", "category_id"], ["company_name"]
    sales = stored("sales", lambda: rollups.product_sales(
        model.order_lines, model.products, by_product, model.extent("products", by_product)
    ))
    activity = stored("activity", lambda: rollups.customer_activity(
        rollups.with_periods(model.orders), model.customers, ["company_name", "order_year"],
        model.extent("customers", by_name),
    ))
    calendar = stored("calendar", lambda: rollups.order_calendar(
        rollups.with_periods(model.orders), "order_year", "month_no", "payment_code"
    ))
    suppliers = stored("suppliers", lambda: rollups.supplier_products(
        model.products, model.suppliers, model.extent("suppliers", by_name)
    ))

    def activity_in_year() -> DataFrame:
        return activity().filter(F.col("order_year") == year)

    def lines_per_product() -> DataFrame:
        return reports.order_lines_per_product(sales(), model.products)

    def customers_in_year() -> DataFrame:
        return reports.orders_per_customer(activity_in_year())

    def per_category() -> DataFrame:
        extent = model.extent("categories", ["category_name"])
        return reports.quantity_per_category(sales(), model.categories, extent)

    return {
        "kpi_board": lambda: kpis.kpi_board(
            calendar(), activity(), sales(), kpis.total_revenue(model.order_lines),
            suppliers(), model.products, model.customers, model.suppliers,
        ),
        "top10_products_by_quantity": lambda: reports.top_products_by_quantity(sales(), top),
        "top10_products_by_lines": lambda: reports.top_products_by_lines(sales(), top),
        "bottom10_products_by_lines": lambda: reports.bottom_products_by_lines(sales(), top),
        "orders_per_customer": lambda: reports.orders_per_customer(activity()),
        "orders_per_payment_method": lambda: reports.orders_per_payment_method(
            calendar(), labels, default_label
        ),
        "orders_per_year": lambda: reports.orders_per_year(calendar()),
        "order_lines_per_product": lines_per_product,
        "quantity_per_category": per_category,
        "orders_per_customer_in_year": customers_in_year,
        "products_per_supplier": lambda: reports.products_per_supplier(suppliers()),
        "revenue_per_month": lambda: reports.revenue_per_month(
            model.order_lines, model.orders, year, not model.by_order, model.extent("orders", ["order_date"])
        ),
        "orders_per_month": lambda: charts.orders_per_month(
            calendar().filter(F.col("order_year") == month_year)
        ),
        "top_bottom5_products": lambda: charts.top_bottom_products(lines_per_product(), ends),
        "top_bottom5_customers": lambda: charts.top_bottom_customers(customers_in_year(), ends),
        "top7_customers_in_year": lambda: charts.top_customers(customers_in_year(), slices),
        "top7_suppliers_by_products": lambda: charts.top_suppliers(suppliers(), slices),
        "share_orders_per_year": lambda: share_of_total(
            reports.orders_per_year(calendar()), "order_count"
        ),
        "share_quantity_per_category": lambda: share_of_total(
            per_category(), "quantity_sold"
        ),
        "share_top7": lambda: share_of_total(
            charts.top_customers(customers_in_year(), slices), "order_count"
        ),
    }


def hr_reports(employees: DataFrame) -> dict[str, Report]:
    return {
        "hr_top9_jobs": lambda: hr.top_jobs(employees, 9),
        "hr_max_job_count": lambda: hr.max_job_count(employees),
        "hr_employee_count": lambda: hr.employee_count(employees),
        "hr_department_count": lambda: hr.department_count(employees),
        "hr_avg_salary": lambda: hr.avg_salary(employees),
        "hr_top4_jobs": lambda: charts.with_bar_labels(hr.top_jobs(employees, 4), "employee_count"),
        "share_jobs_top4": lambda: share_of_total(hr.top_jobs(employees, 4), "employee_count"),
        "hr_employee_listing": lambda: hr.employee_listing(employees),
    }


def _run_one(spark: SparkSession, folder: str, name: str, report: Report, keep: int | None) -> tuple:
    try:
        result = report()
        write_report(result, folder, name, keep)
        # Row counts come from the Parquet footers of what was written.
        rows = read_report(spark, folder, name, result.schema).count()
        return (name, True, rows, None)
    except Exception as error:
        return (name, False, None, f"{type(error).__name__}: {error}")


def run_suite(
    spark: SparkSession,
    suite: Mapping[str, Report],
    folder: str,
    at_once: int = 4,
    run: str | None = None,
    rollup_folder: str | None = None,
    keep: int | None = None,
) -> DataFrame:
    """Write every report to ``folder/<report>`` and return one status row each.

    A failing report does not stop the others, and is recorded as an error rather
    than as an empty result. With a ``run`` name the status is committed under it, and
    a rerun of that name repeats the reports that are not yet written. Once all are,
    ``rollup_folder`` is removed. ``keep`` is the number of versions left of each report.
    """
    name = f"{STATUS_TABLE}/{run}"
    before = {}
    if run is not None and has_report(spark, folder, name):
        before = {r["report"]: tuple(r) for r in read_report(spark, folder, name, STATUS).collect() if r["ok"]}
    todo = {report: build for report, build in suite.items() if report not in before}
    one = inheritable_thread_target(spark)(_run_one)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        jobs = [pool.submit(one, spark, folder, report, build, keep) for report, build in todo.items()]
        now = {job.result()[0]: job.result() for job in jobs}
    rows = [(before | now)[report] for report in suite]
    status = spark.createDataFrame(rows, STATUS)
    if run is not None:
        write_report(status.coalesce(1), folder, name, keep=1)
    if rollup_folder is not None and all(row[1] for row in rows):
        parent, _, last = rollup_folder.rstrip("/").rpartition("/")
        versions.Folder(spark, parent).remove(last)
    return status
