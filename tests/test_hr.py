"""Employee figures and the employee file."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest

from orderboard.operators.shares import share_of_total
from orderboard.plans import charts, hr
from orderboard.sources.employees import EMPLOYEE_FILE, read_employees, write_employees

HEADER = ",".join(EMPLOYEE_FILE.fieldNames())

# Jobs in order of first appearance, with their head-counts; five jobs tie at 4.
JOBS = [
    ("OWNER", 1), ("BUYER", 2), ("COOK", 4), ("HOST", 1), ("BAKER", 4), ("DRIVER", 4), ("GUARD", 4),
    ("WAITER", 10), ("PORTER", 4), ("CHEF", 16), ("BARKEEP", 10),
]


@pytest.fixture(scope="module")
def employees(spark, tmp_path_factory):
    lines, employee_id = [HEADER], 99
    for number, (job, count) in enumerate(JOBS):
        for _ in range(count):
            employee_id += 1
            lines.append(
                f"{employee_id},Eva,Paz,E{employee_id},5.1,{employee_id % 28 + 1}/07/2017,{job},"
                f"{2000 + number},{'0.25' if job == 'CHEF' else ''},"
                f"{'' if employee_id == 100 else '100.0'},{number % 3 * 10}.0,Area,1.0"
            )
    path = tmp_path_factory.mktemp("csv") / "employees.csv"
    path.write_text("\n".join(lines) + "\n", encoding="UTF-8")
    return read_employees(spark, str(path))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_typed_columns(employees):
    assert dict(employees.dtypes) | {
        "HIRE_DATE": "date", "SALARY": "decimal(12,2)", "COMMISSION_PCT": "decimal(4,2)",
        "MANAGER_ID_x": "bigint", "DEPARTMENT_ID": "bigint", "MANAGER_ID_y": "bigint",
    } == dict(employees.dtypes)
    first = employees.orderBy("EMPLOYEE_ID").first()
    assert first["MANAGER_ID_x"] is None and first["COMMISSION_PCT"] is None
    assert first["HIRE_DATE"] == datetime.date(2017, 7, 17)


def test_top_jobs_tie_by_first_appearance(employees):
    assert rows(hr.top_jobs(employees, 4)) == [
        ("CHEF", 16), ("WAITER", 10), ("BARKEEP", 10), ("COOK", 4),
    ]
    assert [r[0] for r in rows(hr.top_jobs(employees, 9))][4:] == [
        "BAKER", "DRIVER", "GUARD", "PORTER", "BUYER",
    ]
    assert rows(hr.max_job_count(employees)) == [(16,)]


def test_shares_are_of_the_rows_shown(employees):
    shares = share_of_total(hr.top_jobs(employees, 4), "employee_count")
    assert [r[2:] for r in rows(shares)] == [
        (40.0, "40.0%"), (25.0, "25.0%"), (25.0, "25.0%"), (10.0, "10.0%"),
    ]


def test_bar_labels(employees):
    labelled = charts.with_bar_labels(hr.top_jobs(employees, 2), "employee_count")
    assert rows(labelled) == [("CHEF", 16, "16"), ("WAITER", 10, "10")]


def test_counts_and_average(employees):
    assert rows(hr.employee_count(employees)) == [(60,)]
    assert rows(hr.department_count(employees)) == [(3,)]
    total = sum((2000 + i) * count for i, (_, count) in enumerate(JOBS))
    assert rows(hr.avg_salary(employees))[0][0] == round(Decimal(total) / 60, 2)
    assert hr.employee_listing(employees).columns == HEADER.split(",")


def test_null_jobs_and_departments_do_not_count(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, None, 1), (3, "A", 1)], "employee_id long, job_id string, department_id long"
    )
    assert rows(hr.top_jobs(df, 4)) == [("A", 1)]
    assert rows(hr.department_count(df)) == [(1,)]


def test_file_round_trip(spark, employees, tmp_path):
    path = str(tmp_path / "out")
    write_employees(employees, path)
    assert sorted(rows(read_employees(spark, path)), key=str) == sorted(rows(employees), key=str)
