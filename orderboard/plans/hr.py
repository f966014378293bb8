"""Employee figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.functions.numbers import rounded_avg
from orderboard.operators.counting import most_frequent


def top_jobs(employees: DataFrame, n: int) -> DataFrame:
    """The n most frequent jobs; among equals the one with the smallest employee id."""
    return most_frequent(employees, "job_id", n, "employee_count", first_by="employee_id")


def max_job_count(employees: DataFrame) -> DataFrame:
    return top_jobs(employees, 1).select(F.col("employee_count").alias("max_job_count"))


def employee_count(employees: DataFrame) -> DataFrame:
    return employees.agg(F.count(F.lit(1)).alias("employee_count"))


def department_count(employees: DataFrame) -> DataFrame:
    """Departments that have employees."""
    return employees.agg(F.count_distinct("department_id").alias("department_count"))


def avg_salary(employees: DataFrame) -> DataFrame:
    return employees.agg(rounded_avg("salary").alias("avg_salary"))


def employee_listing(employees: DataFrame) -> DataFrame:
    return employees.select("*")
