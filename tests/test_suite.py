"""The batch job: same rows as single reports, and failures stay apart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

import __spark_entry__ as contract
from orderboard.model import SCHEMAS, OrderModel
from orderboard.plans import suite
from orderboard.scratch import shared_folder
from orderboard.sinks import versions
from orderboard.sinks.reports import read_report, write_report
from orderboard.sources import star_schema

FOLDER = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def written(spark):
    model = star_schema.order_model(spark, FOLDER)
    todo = suite.order_reports(
        spark, model, contract.YEAR, contract.MONTH_YEAR, star_schema.PRIORITY_LABELS
    ) | suite.hr_reports(star_schema.employees(spark, FOLDER))
    out = shared_folder(spark, "reports")
    status = suite.run_suite(spark, todo, out)
    return out, {r["report"]: r for r in status.collect()}


def test_every_report_is_written(written):
    out, status = written
    assert all(r["ok"] for r in status.values()), status
    not_in_suite = {"src_csv_employees", "sql_freight_in_year", "sink_report_roundtrip", "suite_status"}
    not_in_suite |= set(contract._llm_queries())
    single = {n for n in contract.queries() if not n.startswith("kpi_")} - not_in_suite
    assert set(status) == single | {"kpi_board"}


@pytest.mark.parametrize("name", [
    "kpi_board", "top10_products_by_quantity", "orders_per_customer", "orders_per_payment_method",
    "order_lines_per_product", "quantity_per_category", "orders_per_customer_in_year",
    "products_per_supplier", "orders_per_month", "share_orders_per_year",
])
def test_reports_from_stored_rollups_equal_single_ones(spark, written, name):
    out, status = written
    stored = contract._comparable(read_report(spark, out, name))
    assert rows(stored) == rows(contract.queries()[name](spark, FOLDER))
    assert status[name]["rows"] == stored.count()


def test_a_failing_table_fails_only_its_reports(spark, small):
    def broken():
        raise RuntimeError("lines are gone")

    model = OrderModel(**{t: broken if t == "order_lines" else small.table(t) for t in SCHEMAS})
    todo = suite.order_reports(spark, model, 2021, 2021)
    chosen = {k: todo[k] for k in ("top10_products_by_quantity", "quantity_per_category", "orders_per_year")}
    status = {r["report"]: r for r in suite.run_suite(spark, chosen, shared_folder(spark, "out")).collect()}
    assert status["orders_per_year"]["ok"] and status["orders_per_year"]["rows"] == 3
    for name in ("top10_products_by_quantity", "quantity_per_category"):
        assert not status[name]["ok"] and status[name]["rows"] is None
        assert "lines are gone" in status[name]["error"]


def test_a_failed_rollup_is_tried_once(spark):
    tries = []

    def build():
        tries.append(1)
        raise RuntimeError("no")

    table = suite.StoredTable(spark, shared_folder(spark, "rollups"), "t", build)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            table()
    assert len(tries) == 1


def test_writing_again_replaces_the_report(spark):
    out = shared_folder(spark, "out")
    write_report(spark.range(5), out, "r")
    write_report(spark.range(2), out, "r")
    assert rows(read_report(spark, out, "r")) == [(0,), (1,)]


def test_a_failed_run_leaves_the_last_good_report(spark):
    out = shared_folder(spark, "out")
    write_report(spark.range(2), out, "r")
    with pytest.raises(Exception, match="no good"):
        write_report(spark.range(4).selectExpr("if(id = 3, raise_error('no good'), id) AS id"), out, "r")
    assert rows(read_report(spark, out, "r")) == [(0,), (1,)]


def test_a_rerun_repeats_only_what_failed(spark, small):
    out, kept = shared_folder(spark, "out"), shared_folder(spark, "rollups")
    broken, built = {"orders_per_year"}, []

    def counted(name, build):
        def report():
            built.append(name)
            if name in broken:
                raise RuntimeError("not now")
            return build()

        return report

    def run(**options):
        todo = suite.order_reports(spark, small, 2021, 2021, rollup_folder=kept)
        chosen = {k: counted(k, todo[k]) for k in ("top10_products_by_quantity", "orders_per_year", "orders_per_month")}
        return {r["report"]: tuple(r)[1:3] for r in suite.run_suite(spark, chosen, out, rollup_folder=kept, **options).collect()}

    first = run(run="2021")
    assert first == {"top10_products_by_quantity": (True, 3), "orders_per_year": (False, None), "orders_per_month": (True, 3)}
    assert set(versions.Folder(spark, kept).names()) == {"sales", "calendar"}  # left for the rerun
    before = set(versions.Folder(spark, kept).names("calendar/runs"))
    broken.clear()
    built.clear()
    assert run(run="2021") == first | {"orders_per_year": (True, 3)}
    assert built == ["orders_per_year"] and len(before) == 1
    assert versions.Folder(spark, kept).names() == []  # removed at the end
    built.clear()
    run(run="2021")
    assert built == []
    assert run(run="other") and sorted(built) == ["orders_per_month", "orders_per_year", "top10_products_by_quantity"]


def test_rows_shown_are_a_parameter(spark, small):
    todo = suite.order_reports(spark, small, 2021, 2021, top=1, ends=1, slices=1)
    for name, n in {
        "top10_products_by_quantity": 1, "bottom10_products_by_lines": 1, "top_bottom5_products": 2,
        "top7_customers_in_year": 1, "share_top7": 1, "top7_suppliers_by_products": 1,
    }.items():
        assert todo[name]().count() == n


def test_old_versions_are_pruned(spark):
    out = shared_folder(spark, "out")
    for i in range(4):
        assert write_report(spark.range(i), out, "r", keep=2) == i + 1
    assert len(versions.Folder(spark, f"{out}/r").names("runs")) == 2
    assert read_report(spark, out, "r").count() == 3
    with pytest.raises(ValueError):
        versions.prune(spark, f"{out}/r", 0)


def test_the_last_commit_wins_whatever_clocks_say(spark, monkeypatch):
    out = shared_folder(spark, "out")
    for clock, n in ((2e9, 3), (1e9, 5)):  # the second writer's clock is decades behind
        monkeypatch.setattr("time.time", lambda clock=clock: clock)
        monkeypatch.setattr("time.time_ns", lambda clock=clock: int(clock * 1e9))
        write_report(spark.range(n), out, "r")
    assert read_report(spark, out, "r").count() == 5


def test_writers_at_once_get_numbers_of_their_own(spark):
    out = shared_folder(spark, "out") + "/r"
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda i: versions.commit(spark, out, f"w{i}"), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    assert versions.latest(spark, out) == f"w{numbers.index(24)}"


def test_an_unfinished_commit_does_not_count(spark):
    out = shared_folder(spark, "out") + "/r"
    assert versions.latest(spark, out) is None
    versions.commit(spark, out, "good")
    folder = versions.Folder(spark, out)
    assert folder.create("versions/000000000002", "")  # a writer died after taking the number
    assert not folder.create("versions/000000000002", "late")
    assert versions.latest(spark, out) == "good" and versions.commit(spark, out, "next") == 3
    assert versions.prune(spark, out, 1) == ["good"] and versions.latest(spark, out) == "next"


def test_exclusive_creation_by_spark_s_file_systems(spark, monkeypatch):
    """The path that other file systems than a mounted one take."""
    monkeypatch.setattr(versions, "MOUNTED", "none")
    out = shared_folder(spark, "out") + "/r"
    assert versions.commit(spark, out, "one") == 1 and versions.commit(spark, out, "two") == 2
    assert not versions.Folder(spark, out).create("versions/000000000001", "again")
    assert versions.latest(spark, out) == "two"
