"""DuckDB statements that state each registered query independently.

They join first and group by name, as a report is read, and share no code with
the package. Counts are bigint and decimals double on both sides.
"""

from __future__ import annotations

# The driver's tables as an order model, and customers as employees.
MODEL = """
orders_ AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         nullif(o_orderstatus, 'P') AS employee_id, o_orderdate AS order_date,
         o_orderpriority AS payment_code, CAST(o_totalprice AS DECIMAL(12,2)) AS freight
  FROM orders),
lines_ AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id,
         CAST(l_quantity AS DECIMAL(12,2)) AS quantity,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price
  FROM lineitem),
products_ AS (
  SELECT p_partkey AS product_id, p_name AS product_name,
         CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
         p_partkey * 7919 % 1009 AS units_in_stock, p_type AS category_id,
         (SELECT min(l_suppkey) FROM lineitem WHERE l_partkey = p_partkey) AS supplier_id
  FROM part),
customers_ AS (SELECT c_custkey AS customer_id, c_name AS company_name FROM customer),
suppliers_ AS (SELECT s_suppkey AS supplier_id, s_name AS company_name FROM supplier),
categories_ AS (SELECT DISTINCT p_type AS category_id, p_type AS category_name FROM part),
employees_ AS (
  SELECT c_custkey AS EMPLOYEE_ID, c_mktsegment AS FIRST_NAME, c_name AS LAST_NAME,
         upper(c_name) AS EMAIL, CAST(c_custkey AS VARCHAR) AS PHONE_NUMBER,
         (SELECT strftime(min(o_orderdate), '%Y-%m-%d') FROM orders WHERE o_custkey = c_custkey)
           AS HIRE_DATE,
         n_name AS JOB_ID, CAST(c_acctbal AS DECIMAL(12,2)) AS SALARY,
         CASE WHEN c_acctbal > 5000 THEN 0.25 END AS COMMISSION_PCT,
         c_nationkey AS MANAGER_ID_x, r_regionkey AS DEPARTMENT_ID,
         r_name AS DEPARTMENT_NAME, r_regionkey AS MANAGER_ID_y
  FROM customer JOIN nation ON c_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)
"""

# Reports that others are defined on.
CUSTOMERS_IN_YEAR = """
customers_in_year AS (
  SELECT company_name, count(order_id) AS order_count
  FROM orders_ JOIN customers_ USING (customer_id)
  WHERE extract(year FROM order_date) = 1998 GROUP BY company_name)
"""
LINES_PER_PRODUCT = """
lines_per_product AS (
  SELECT product_name, coalesce(count(order_id), 0) AS order_count
  FROM products_ LEFT JOIN lines_ USING (product_id) GROUP BY product_name)
"""
PRODUCTS_PER_SUPPLIER = """
products_of AS (
  SELECT company_name, count(product_id) AS product_count
  FROM products_ JOIN suppliers_ USING (supplier_id) GROUP BY company_name)
"""
TOP_JOBS = """
jobs AS (
  SELECT JOB_ID AS job_id, count(*) AS employee_count FROM employees_ WHERE JOB_ID IS NOT NULL
  GROUP BY JOB_ID ORDER BY count(*) DESC, min(EMPLOYEE_ID), JOB_ID)
"""


def _with(body: str, *more: str) -> str:
    return "WITH " + ",".join([MODEL, *more]) + body


def _share(label: str, measure: str, source: str) -> str:
    return f"""
SELECT {label}, CAST({measure} AS {{kind}}) AS {measure}, share_pct,
       printf('%.1f%%', share_pct) AS share_text
FROM (SELECT {label}, {measure},
             round(CAST({measure} AS DOUBLE) * 100.0 / (SELECT CAST(sum({measure}) AS DOUBLE) FROM {source}), 1)
               AS share_pct
      FROM {source})
"""


def _top_bottom(label: str, source: str) -> str:
    return f"""
SELECT {label}, order_count, 'top' AS section
FROM (FROM {source} ORDER BY order_count DESC, {label} LIMIT 5)
UNION ALL
SELECT {label}, order_count, 'bottom'
FROM (FROM {source} ORDER BY order_count, {label} DESC LIMIT 5)
"""


def _ranked(measure: str, alias: str, cast: str, direction: str) -> str:
    return _with(f"""
SELECT product_name, CAST(m AS {cast}) AS {alias}, ranking FROM (
  SELECT product_name, {measure} AS m,
         row_number() OVER (ORDER BY {measure} {direction}, product_name) AS ranking
  FROM lines_ JOIN products_ USING (product_id) GROUP BY product_name)
WHERE ranking <= 10
""")


QUANTITY_PER_CATEGORY = """
SELECT category_name, CAST(sum(quantity) AS DOUBLE) AS quantity_sold
FROM lines_ JOIN products_ USING (product_id) JOIN categories_ USING (category_id)
GROUP BY category_name
"""

ORDERS_PER_YEAR = """
SELECT strftime(order_date, '%Y') AS order_year, count(order_id) AS order_count
FROM orders_ GROUP BY 1
"""

EMPLOYEE_LISTING = """
SELECT EMPLOYEE_ID, FIRST_NAME, LAST_NAME, EMAIL, PHONE_NUMBER, HIRE_DATE, JOB_ID,
       CAST(SALARY AS DOUBLE) AS SALARY, CAST(COMMISSION_PCT AS DOUBLE) AS COMMISSION_PCT,
       CAST(MANAGER_ID_x AS BIGINT) AS MANAGER_ID_x, CAST(DEPARTMENT_ID AS BIGINT) AS DEPARTMENT_ID,
       DEPARTMENT_NAME, CAST(MANAGER_ID_y AS BIGINT) AS MANAGER_ID_y
FROM employees_
"""

PRICIEST = "SELECT product_name FROM products_ WHERE unit_price = (SELECT max(unit_price) FROM products_)"
BEST_SELLING = """
SELECT product_name FROM lines_ JOIN products_ USING (product_id)
GROUP BY product_name ORDER BY sum(quantity) DESC NULLS FIRST, product_name LIMIT 1"""
TOP_CUSTOMER = """
SELECT company_name FROM customers_ JOIN orders_ USING (customer_id)
GROUP BY company_name ORDER BY count(order_id) DESC, company_name LIMIT 1"""
TOP_SUPPLIER = """
SELECT company_name FROM suppliers_ JOIN products_ USING (supplier_id)
GROUP BY company_name ORDER BY count(*) DESC, company_name LIMIT 1"""
MAX_FREIGHT = """
SELECT company_name FROM customers_ JOIN orders_ USING (customer_id)
GROUP BY company_name ORDER BY max(freight) DESC NULLS FIRST, company_name LIMIT 1"""
LATEST = "SELECT strftime(max(order_date), '%d/%m/%Y') AS latest_order FROM orders_"
MOST_STOCK = """
SELECT product_name FROM products_
GROUP BY product_name ORDER BY max(units_in_stock) DESC NULLS FIRST, product_name LIMIT 1"""
LEAST_STOCK = """
SELECT product_name FROM products_
GROUP BY product_name ORDER BY min(units_in_stock) ASC NULLS LAST, product_name LIMIT 1"""

BOARD = f"""
SELECT 'order_count' AS kpi, CAST((SELECT count(*) FROM orders_) AS VARCHAR) AS value
UNION ALL SELECT 'priciest_product', (SELECT min(product_name) FROM ({PRICIEST}))
UNION ALL SELECT 'best_selling_product', ({BEST_SELLING})
UNION ALL SELECT 'top_customer', ({TOP_CUSTOMER})
UNION ALL SELECT 'total_revenue',
  CAST((SELECT CAST(sum(quantity * unit_price) AS DECIMAL(38,4)) FROM lines_) AS VARCHAR)
UNION ALL SELECT 'avg_price',
  CAST((SELECT CAST(round(avg(unit_price), 2) AS DECIMAL(14,2)) FROM products_) AS VARCHAR)
UNION ALL SELECT 'top_supplier', ({TOP_SUPPLIER})
UNION ALL SELECT 'max_freight_customer', ({MAX_FREIGHT})
UNION ALL SELECT 'customer_count', CAST((SELECT count(*) FROM customers_) AS VARCHAR)
UNION ALL SELECT 'supplier_count', CAST((SELECT count(*) FROM suppliers_) AS VARCHAR)
UNION ALL SELECT 'latest_order', ({LATEST})
UNION ALL SELECT 'most_stock', ({MOST_STOCK})
UNION ALL SELECT 'least_stock', ({LEAST_STOCK})
UNION ALL SELECT 'orders_without_rep',
  CAST((SELECT count(*) FROM orders_ WHERE employee_id IS NULL) AS VARCHAR)
"""

STATEMENTS: dict[str, str] = {
    "kpi_order_count": _with("SELECT count(*) AS order_count FROM orders_"),
    "kpi_priciest_product": _with(PRICIEST),
    "kpi_best_selling_product": _with(BEST_SELLING),
    "kpi_top_customer": _with(TOP_CUSTOMER),
    "kpi_total_revenue": _with(
        "SELECT CAST(sum(quantity * unit_price) AS DOUBLE) AS total_revenue FROM lines_"
    ),
    "kpi_avg_price": _with("SELECT round(avg(unit_price), 2) AS avg_price FROM products_"),
    "kpi_top_supplier": _with(TOP_SUPPLIER),
    "kpi_max_freight_customer": _with(MAX_FREIGHT),
    "kpi_customer_count": _with("SELECT count(*) AS customer_count FROM customers_"),
    "kpi_supplier_count": _with("SELECT count(*) AS supplier_count FROM suppliers_"),
    "kpi_latest_order": _with(LATEST),
    "kpi_most_stock": _with(MOST_STOCK),
    "kpi_least_stock": _with(LEAST_STOCK),
    "kpi_orders_without_rep": _with(
        "SELECT count(*) AS orders_without_rep FROM orders_ WHERE employee_id IS NULL"
    ),
    "kpi_board": _with(BOARD),
    "top10_products_by_quantity": _ranked("sum(quantity)", "quantity_sold", "DOUBLE", "DESC"),
    "top10_products_by_lines": _ranked("count(*)", "line_count", "BIGINT", "DESC"),
    "bottom10_products_by_lines": _ranked("count(*)", "line_count", "BIGINT", "ASC"),
    "orders_per_customer": _with("""
SELECT company_name, count(order_id) AS order_count
FROM customers_ JOIN orders_ USING (customer_id)
GROUP BY company_name ORDER BY order_count DESC"""),
    "orders_per_payment_method": _with("""
SELECT CASE WHEN payment_code = '1-URGENT' THEN 'EFECTIVO'
            WHEN payment_code = '2-HIGH' THEN 'CREDITO' ELSE 'OTRO' END AS payment_method,
       count(*) AS order_count
FROM orders_ GROUP BY payment_code"""),
    "orders_per_year": _with(ORDERS_PER_YEAR),
    "order_lines_per_product": _with(" FROM lines_per_product", LINES_PER_PRODUCT),
    "quantity_per_category": _with(QUANTITY_PER_CATEGORY),
    "orders_per_customer_in_year": _with(" FROM customers_in_year", CUSTOMERS_IN_YEAR),
    "products_per_supplier": _with(" FROM products_of", PRODUCTS_PER_SUPPLIER),
    "revenue_per_month": _with("""
SELECT month(order_date) AS month_no, strftime(order_date, '%B') AS month_name,
       CAST(sum(quantity * unit_price) AS DOUBLE) AS revenue
FROM lines_ JOIN orders_ USING (order_id)
WHERE extract(year FROM order_date) = 1998 GROUP BY 1, 2"""),
    "orders_per_month": _with("""
SELECT month(order_date) AS month_no, strftime(order_date, '%B') AS month_name,
       count(order_id) AS order_count
FROM orders_ WHERE strftime(order_date, '%Y') = '1997' GROUP BY 1, 2"""),
    "top_bottom5_products": _with(
        _top_bottom("product_name", "lines_per_product"), LINES_PER_PRODUCT
    ),
    "top_bottom5_customers": _with(
        _top_bottom("company_name", "customers_in_year"), CUSTOMERS_IN_YEAR
    ),
    "top7_customers_in_year": _with(
        " FROM customers_in_year ORDER BY order_count DESC, company_name LIMIT 7", CUSTOMERS_IN_YEAR
    ),
    "top7_suppliers_by_products": _with(
        " FROM products_of ORDER BY product_count DESC, company_name LIMIT 7", PRODUCTS_PER_SUPPLIER
    ),
    "share_jobs_top4": _with(
        _share("job_id", "employee_count", "top_jobs").format(kind="BIGINT"),
        TOP_JOBS, "top_jobs AS (FROM jobs LIMIT 4)",
    ),
    "share_orders_per_year": _with(
        _share("order_year", "order_count", "per_year").format(kind="BIGINT"),
        f"per_year AS ({ORDERS_PER_YEAR})",
    ),
    "share_quantity_per_category": _with(
        _share("category_name", "quantity_sold", "per_category").format(kind="DOUBLE"),
        f"per_category AS ({QUANTITY_PER_CATEGORY})",
    ),
    "share_top7": _with(
        _share("company_name", "order_count", "top7").format(kind="BIGINT"),
        CUSTOMERS_IN_YEAR,
        "top7 AS (FROM customers_in_year ORDER BY order_count DESC, company_name LIMIT 7)",
    ),
    "hr_top9_jobs": _with(" FROM jobs LIMIT 9", TOP_JOBS),
    "hr_max_job_count": _with(" SELECT max(employee_count) AS max_job_count FROM jobs", TOP_JOBS),
    "hr_employee_count": _with("SELECT count(*) AS employee_count FROM employees_"),
    "hr_department_count": _with(
        "SELECT count(DISTINCT DEPARTMENT_ID) AS department_count FROM employees_"
    ),
    "hr_avg_salary": _with("SELECT round(avg(SALARY), 2) AS avg_salary FROM employees_"),
    "hr_top4_jobs": _with(
        " SELECT *, CAST(employee_count AS VARCHAR) AS bar_label FROM (FROM jobs LIMIT 4)", TOP_JOBS
    ),
    "hr_employee_listing": _with(EMPLOYEE_LISTING),
    "src_csv_employees": _with(EMPLOYEE_LISTING),
    "sql_freight_in_year": """
        SELECT o_orderpriority AS payment_code, count(*) AS order_count,
               CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS freight_total,
               CAST(max(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS freight_max
        FROM orders WHERE year(o_orderdate) = 1998 GROUP BY o_orderpriority""",
    "sink_report_roundtrip": _with(" FROM lines_per_product", LINES_PER_PRODUCT),
}

# One status row per report of the batch job, with the rows each statement above gives.
SUITE = [
    "kpi_board", "top10_products_by_quantity", "top10_products_by_lines",
    "bottom10_products_by_lines", "orders_per_customer", "orders_per_payment_method",
    "orders_per_year", "order_lines_per_product", "quantity_per_category",
    "orders_per_customer_in_year", "products_per_supplier", "revenue_per_month",
    "orders_per_month", "top_bottom5_products", "top_bottom5_customers",
    "top7_customers_in_year", "top7_suppliers_by_products", "share_orders_per_year",
    "share_quantity_per_category", "share_top7", "hr_top9_jobs", "hr_max_job_count",
    "hr_employee_count", "hr_department_count", "hr_avg_salary", "hr_top4_jobs",
    "share_jobs_top4", "hr_employee_listing",
]
STATEMENTS["suite_status"] = " UNION ALL ".join(
    f"SELECT '{name}' AS report, true AS ok, (SELECT count(*) FROM ({STATEMENTS[name]})) AS rows"
    for name in SUITE
)
