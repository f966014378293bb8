"""Readers and the models they build."""

from __future__ import annotations

import datetime
from decimal import Decimal as D

import duckdb
import pytest
from fixtures import ROWS
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from orderboard.model import SCHEMAS, LossyColumn, OrderModel, reconciled
from orderboard.plans import kpis
from orderboard.scratch import CHECKPOINT_DIR, shared_folder
from orderboard.sources import jdbc, order_db
from orderboard.sources.files import read_csv, read_order_model
from orderboard.sources.sql import run_sql


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_model_from_files(spark, small, tmp_path, file_format):
    for name in SCHEMAS:
        writer = small.table(name).write
        if file_format == "csv":
            writer.csv(str(tmp_path / name), header=True)
        else:
            writer.parquet(str(tmp_path / name))
    model = read_order_model(spark, str(tmp_path), file_format)
    for name in SCHEMAS:
        assert rows(model.table(name)) == sorted(ROWS[name], key=str)


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown format"):
        read_order_model(spark, "/nowhere", "xml")


def test_csv_rejects_bad_values_and_wrong_headers(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("supplier_id,company_name\nx,Norte\n")
    with pytest.raises(Exception, match="FAILFAST"):
        read_csv(spark, str(bad), SCHEMAS["suppliers"]).collect()
    swapped = tmp_path / "swapped.csv"
    swapped.write_text("company_name,supplier_id\n1,2\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(swapped), SCHEMAS["suppliers"]).collect()


def test_missing_table_and_column(spark):
    with pytest.raises(ValueError, match="expected the tables"):
        OrderModel(orders=spark.range(1))
    model = OrderModel(**{t: (lambda: spark.range(1)) for t in SCHEMAS})
    with pytest.raises(ValueError, match="'orders' lacks columns"):
        model.orders


def test_tables_are_read_when_asked(small):
    read = []
    model = OrderModel(**{
        t: (lambda t=t: read.append(t) or small.table(t)) for t in SCHEMAS
    })
    kpis.customer_count(model.customers).collect()
    model.customers
    assert read == ["customers"]


def test_spanish_database(small):
    ours = small

    def exported(table):
        target, columns = order_db.TABLES[table]
        df = ours.table(target)
        return df.toDF(*[{v: k.upper() for k, v in columns.items()}[c] for c in df.columns])

    model = order_db.order_model(exported)
    for name in SCHEMAS:
        assert model.table(name).columns == ours.table(name).columns
        assert rows(model.table(name)) == rows(ours.table(name))


def test_spanish_database_names_missing_columns(spark):
    model = order_db.order_model(lambda table: spark.range(1))
    with pytest.raises(ValueError, match="'CLIENTES' lacks columns"):
        model.customers


def test_sql_over_the_model(spark, small):
    text = "SELECT company_name FROM {customers} WHERE customer_id > :least ORDER BY customer_id"
    df = run_sql(spark, text, small, least=2)
    assert [r[0] for r in df.collect()] == ["Caro", "Ana", None]
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT nothing FROM {customers}", small).collect()


def test_jdbc_options():
    connection = {"url": "jdbc:x", "user": "u", "password": "p"}
    table = jdbc.table_options(connection, "PEDIDOS", "id_pedido", 1, 1000, 8)
    assert table == {
        "fetchsize": "10000", "url": "jdbc:x", "user": "u", "password": "p",
        "dbtable": "PEDIDOS", "partitionColumn": "id_pedido",
        "lowerBound": "1", "upperBound": "1000", "numPartitions": "8",
    }
    query = jdbc.query_options({**connection, "fetchsize": "5"}, "SELECT 1")
    assert query["query"] == "SELECT 1" and query["fetchsize"] == "5" and "dbtable" not in query
    with pytest.raises(ValueError):
        jdbc.table_options(connection, "PEDIDOS", "id_pedido", 1, 1000, 0)


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows has one key, some have none; keys have gaps."""
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE t AS SELECT i AS line, CASE WHEN i % 3 = 0 THEN 77 WHEN i % 50 = 1 THEN NULL"
        " ELSE (i * i) % 100003 END AS k, CASE WHEN i % 7 = 0 THEN NULL ELSE i - 500 END AS w,"
        " chr(110) || chr(39) || lpad((i % 40)::VARCHAR, 2, '0') AS name, DATE '2020-01-01' + (i % 90)::INT AS day FROM range(3000) r(i)"
    )
    return con


def shares(con, source, predicates):
    """Rows under each condition; every row must meet exactly one."""
    conditions = [f"CASE WHEN {p} THEN 1 ELSE 0 END" for p in predicates]
    least, most = con.execute(f"SELECT min(n), max(n) FROM (SELECT {' + '.join(conditions)} AS n FROM {source} s)").fetchone()
    assert (least, most) == (1, 1)
    return [con.execute(f"SELECT count(*) FROM {source} s WHERE {p}").fetchone()[0] for p in predicates]


@pytest.mark.parametrize("source", ["t", "(SELECT * FROM t WHERE line < 2000)"])
@pytest.mark.parametrize("column", ["k", "name", "day", "line"])
@pytest.mark.parametrize("parts", [1, 7, 16])
def test_parts_of_a_table_are_disjoint_complete_and_balanced(skewed, source, column, parts):
    total = skewed.execute(f"SELECT count(*) FROM {source} s").fetchone()[0]
    lows = [r[1] for r in skewed.execute(jdbc.bounds_statement(source, column, parts)).fetchall()]
    within = shares(skewed, source, jdbc.range_predicates(column, lows, "w"))
    whole = shares(skewed, source, jdbc.range_predicates(column, lows))
    assert sum(within) == sum(whole) == total
    if column == "line":
        assert max(within) <= total / parts + 1
    if column == "k" and parts == 16:
        # The hot key is a third: whole it is one large part, by a second column it is not.
        assert max(whole) >= total / 3 and max(within) <= 2 * total / parts


def test_parts_without_rows_and_odd_keys():
    assert jdbc.range_predicates("k", []) == ["1 = 1"]
    assert jdbc.range_predicates("k", ["O'H"]) == ["k IS NULL", "k < 'O''H'", "k >= 'O''H'"]
    assert jdbc.literal(D("1.50")) == "1.50"
    assert jdbc.literal(datetime.datetime(2020, 1, 2, 3)) == "TIMESTAMP '2020-01-02 03:00:00'"
    for key in (1.5, None, True):
        with pytest.raises(TypeError):
            jdbc.literal(key)
    with pytest.raises(ValueError):
        jdbc.bounds_statement("t", "k", 0)


class FakeReader:
    """Stands in for ``spark.read``: answers statements by DuckDB, notes table reads."""

    def __init__(self, spark, con):
        self.spark, self.con, self.parts = spark, con, None

    @property
    def read(self):
        return self

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.statement = options["query"]
        return self

    def load(self):
        return self.spark.createDataFrame(self.con.execute(self.statement).df())

    def jdbc(self, url, table, predicates, properties):
        self.parts = (url, table, predicates, properties)
        return self


def test_large_statements_are_read_in_parts_or_refused(spark, skewed):
    connection = {"url": "jdbc:x", "user": "u"}
    fake = FakeReader(spark, skewed)
    assert jdbc.read_query(fake, connection, "SELECT line FROM t WHERE line < 5", max_rows=5).count() == 5
    with pytest.raises(jdbc.TooLarge, match="3000 rows are more than 2999"):
        jdbc.read_query(fake, connection, "SELECT line FROM t", max_rows=2999)
    jdbc.read_query_in_parts(fake, connection, "SELECT * FROM t", "line", 6)
    url, table, predicates, properties = fake.parts
    assert (url, table, properties) == ("jdbc:x", "(SELECT * FROM t) q", {"fetchsize": "10000", "user": "u"})
    assert shares(skewed, "t", predicates) == [0, 0, *[500] * 6]
    jdbc.read_table_balanced(fake, connection, "t", "k", 6, "w")
    assert fake.parts[1] == "t" and sum(shares(skewed, "t", fake.parts[2])) == 3000


@pytest.mark.parametrize(("column", "kind"), [
    ("unit_price", "double"), ("product_id", "decimal(38,0)"), ("product_id", "decimal(12,2)"),
    ("unit_price", "decimal(12,3)"), ("unit_price", "bigint"), ("product_id", "string"), ("product_name", "int"),
])
def test_lossy_types_are_refused_by_column(spark, small, column, kind):
    df = small.products.withColumn(column, F.col(column).try_cast(kind))
    with pytest.raises(LossyColumn, match=f"'products': {column} is {kind.replace('(', '.').replace(')', '.')}"):
        reconciled(df, "products")


@pytest.mark.parametrize(("column", "kind"), [
    ("product_id", "int"), ("product_id", "decimal(18,0)"), ("unit_price", "decimal(5,1)"), ("unit_price", "int"),
    ("units_in_stock", "smallint"), ("category_id", "string"),
])
def test_exact_types_are_read(spark, small, column, kind):
    df = small.products.withColumn(column, F.col(column).cast(kind))
    got = reconciled(df, "products")
    wanted = "string" if column == "category_id" else SCHEMAS["products"][column].dataType.simpleString()
    assert got.schema[column].dataType.simpleString() == wanted
    assert rows(got.select(column)) == rows(df.select(F.col(column).cast(wanted)))


def test_tested_columns_are_refused_by_value(spark):
    def products(ids, price):
        return spark.createDataFrame(
            [(D(i), "n", price, 1, 1, 1) for i in ids],
            "product_id decimal(38,10), product_name string, unit_price double, units_in_stock long,"
            " supplier_id long, category_id long",
        )

    tested = ("product_id", "unit_price")
    assert rows(reconciled(products(["1", "-20"], 0.1), "products", tested).select("product_id", "unit_price")) == [
        (-20, D("0.10")), (1, D("0.10"))
    ]
    for bad in (products(["1.5"], 0.1), products(["1"], 0.123), products([10**20], 0.1), products(["1"], 1e12)):
        with pytest.raises(Exception, match="column (product_id|unit_price): "):
            reconciled(bad, "products", tested).collect()


def test_model_from_files_refuses_by_type(spark, small, tmp_path):
    for name in SCHEMAS:
        df = small.table(name)
        if name == "products":
            df = df.withColumn("unit_price", F.col("unit_price").cast("double"))
        df.write.parquet(str(tmp_path / name))
    with pytest.raises(LossyColumn, match="unit_price is double"):
        read_order_model(spark, str(tmp_path)).products
    assert rows(read_order_model(spark, str(tmp_path), tested=["unit_price"]).products) == rows(small.products)


def test_shared_folder(spark):
    base = spark.conf.get(CHECKPOINT_DIR)
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(f"{base}/x-") and first != second
