"""The employee file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderboard.model import MONEY
from orderboard.sources.files import read_csv

# The columns of the employee file, in file order.
EMPLOYEE_FILE = T.StructType([
    T.StructField("EMPLOYEE_ID", T.LongType()),
    T.StructField("FIRST_NAME", T.StringType()),
    T.StructField("LAST_NAME", T.StringType()),
    T.StructField("EMAIL", T.StringType()),
    T.StructField("PHONE_NUMBER", T.StringType()),
    T.StructField("HIRE_DATE", T.StringType()),
    T.StructField("JOB_ID", T.StringType()),
    T.StructField("SALARY", MONEY),
    T.StructField("COMMISSION_PCT", T.DecimalType(4, 2)),
    T.StructField("MANAGER_ID_x", T.DoubleType()),
    T.StructField("DEPARTMENT_ID", T.DoubleType()),
    T.StructField("DEPARTMENT_NAME", T.StringType()),
    T.StructField("MANAGER_ID_y", T.DoubleType()),
])
# Ids with gaps are written like 90.0.
DECIMAL_POINT_IDS = ("MANAGER_ID_x", "DEPARTMENT_ID", "MANAGER_ID_y")
HIRE_DATE_FORMAT = "d/MM/yyyy"


def read_employees(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, EMPLOYEE_FILE)
    typed = {c: F.col(c).cast("long") for c in DECIMAL_POINT_IDS}
    typed["HIRE_DATE"] = F.to_date("HIRE_DATE", HIRE_DATE_FORMAT)
    return raw.withColumns(typed)


def write_employees(employees: DataFrame, path: str) -> None:
    """Typed employees in the file's format."""
    texts = {c: F.col(c).cast("double") for c in DECIMAL_POINT_IDS}
    texts["HIRE_DATE"] = F.date_format("HIRE_DATE", HIRE_DATE_FORMAT)
    employees.withColumns(texts).select(EMPLOYEE_FILE.fieldNames()).write.mode("overwrite").csv(
        path, header=True, sep=",", encoding="UTF-8"
    )
