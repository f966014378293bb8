"""Star-schema Parquet tables (orders, lineitem, part, ...) as an ``OrderModel``.

Every derived column is an expression or a join on a unique key, so Catalyst
drops the ones a report does not read together with their scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderboard.model import OrderModel, require_columns
from orderboard.operators.extents import measured
from orderboard.sources.files import read_parquet

# Labels for the two of the five order priorities that stand for known payment codes.
PRIORITY_LABELS = {"1-URGENT": "EFECTIVO", "2-HIGH": "CREDITO"}


# The columns of the tables that are read.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double,"
    " c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double,"
    " l_extendedprice double",
}


# Files whose columns an application has checked: (application id, path).
_CHECKED: set[tuple[str, str]] = set()


class StarSchema:
    """The tables of one folder, ``<folder>/<table>.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """The declared columns; one that the files lack fails by name, not as NULLs.

        Footers are opened for that once for each path and application.
        """
        path = f"{self._folder}/{name}.parquet"
        declared = read_parquet(self._spark, path, COLUMNS[name])
        if (seen := (self._spark.sparkContext.applicationId, path)) not in _CHECKED:
            require_columns(read_parquet(self._spark, path), name, declared.columns)
            _CHECKED.add(seen)
        return declared

    def orders(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "nullif(o_orderstatus, 'P') AS employee_id",
            "o_orderdate AS order_date",
            "o_orderpriority AS payment_code",
            "CAST(o_totalprice AS DECIMAL(12,2)) AS freight",
        )

    def order_lines(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "CAST(l_quantity AS DECIMAL(12,2)) AS quantity",
            "CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price",
        )

    def products(self) -> DataFrame:
        # The tables hold no supplier of a part; take the first that delivered it.
        # Nor a stock level; the one here differs between parts.
        delivered_by = self.table("lineitem").groupBy("l_partkey").agg(F.min("l_suppkey"))
        return (
            self.table("part")
            .selectExpr(
                "p_partkey AS product_id",
                "p_name AS product_name",
                "CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price",
                "p_partkey * 7919 % 1009 AS units_in_stock",
                "p_type AS category_id",
            )
            .join(delivered_by.toDF("product_id", "supplier_id"), "product_id", "left")
        )

    def customers(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS customer_id", "c_name AS company_name"
        )

    def suppliers(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS supplier_id", "s_name AS company_name"
        )

    def categories(self) -> DataFrame:
        types = self.table("part").select("p_type").distinct()
        return types.selectExpr("p_type AS category_id", "p_type AS category_name")

    def employees(self) -> DataFrame:
        """Customers as employees: job by nation, department by region."""
        hired = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate"))
        return (
            self.table("customer")
            .join(hired.toDF("c_custkey", "first_order"), "c_custkey", "left")
            .join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
            .join(self.table("region"), F.expr("n_regionkey = r_regionkey"))
            .selectExpr(
                "c_custkey AS EMPLOYEE_ID",
                "c_mktsegment AS FIRST_NAME",
                "c_name AS LAST_NAME",
                "upper(c_name) AS EMAIL",
                "CAST(c_custkey AS STRING) AS PHONE_NUMBER",
                "CAST(first_order AS DATE) AS HIRE_DATE",
                "n_name AS JOB_ID",
                "CAST(c_acctbal AS DECIMAL(12,2)) AS SALARY",
                "CASE WHEN c_acctbal > 5000 THEN CAST(0.25 AS DECIMAL(4,2)) END AS COMMISSION_PCT",
                "CAST(c_nationkey AS BIGINT) AS MANAGER_ID_x",
                "CAST(r_regionkey AS BIGINT) AS DEPARTMENT_ID",
                "r_name AS DEPARTMENT_NAME",
                "CAST(r_regionkey AS BIGINT) AS MANAGER_ID_y",
            )
        )


# Measured records by application id and folder.
_EXTENTS: dict[tuple[str, str], dict] = {}


def order_model(spark: SparkSession, folder: str) -> OrderModel:
    """The model over one folder, with the record of its dimensions.

    They are measured when an application first opens the folder; building reports
    runs nothing.
    """
    model = _unmeasured_model(spark, folder)
    seen = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if seen not in _EXTENTS:
        _EXTENTS[seen] = measured(model)
    model.extents = _EXTENTS[seen]
    return model


def _unmeasured_model(spark: SparkSession, folder: str) -> OrderModel:
    tables = StarSchema(spark, folder)
    return OrderModel(
        orders=tables.orders,
        order_lines=tables.order_lines,
        products=tables.products,
        customers=tables.customers,
        suppliers=tables.suppliers,
        categories=tables.categories,
    )


def employees(spark: SparkSession, folder: str) -> DataFrame:
    return StarSchema(spark, folder).employees()
