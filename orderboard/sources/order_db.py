"""An order database with Spanish table and column names as an ``OrderModel``."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderboard.model import OrderModel, reconciled, require_columns

# Table and column names of the database, and ours.
TABLES = {
    "PEDIDOS": ("orders", {
        "id_pedido": "order_id",
        "id_cliente": "customer_id",
        "employee_id": "employee_id",
        "fecha_pedido": "order_date",
        "forma_pago": "payment_code",
        "valor_envio": "freight",
    }),
    "DETALLES_PEDIDOS": ("order_lines", {
        "id_pedido": "order_id",
        "id_producto": "product_id",
        "cantidad": "quantity",
        "precio_unidad": "unit_price",
    }),
    "PRODUCTOS": ("products", {
        "id_producto": "product_id",
        "nombre_producto": "product_name",
        "precio_por_unidad": "unit_price",
        "unidades_en_existencia": "units_in_stock",
        "id_proveedor": "supplier_id",
        "id_categoria": "category_id",
    }),
    "CLIENTES": ("customers", {
        "id_cliente": "customer_id",
        "nombre_compania": "company_name",
    }),
    "PROVEEDORES": ("suppliers", {
        "id_proveedor": "supplier_id",
        "nombre_compania": "company_name",
    }),
    "CATEGORIAS": ("categories", {
        "id_categoria": "category_id",
        "nombre_categoria": "category_name",
    }),
}


def order_model(read: Callable[[str], DataFrame], tested: Collection[str] = ()) -> OrderModel:
    """``read`` gives the frame of a database table, from JDBC or an export of it.

    Lossy types are refused by column; a number without declared digits arrives as a
    wide decimal and is let in by value where ``tested`` names its column.
    """

    def reader(source: str, target: str, columns: dict[str, str]) -> Callable[[], DataFrame]:
        def load() -> DataFrame:
            df = read(source)
            require_columns(df, source, columns)
            ours = df.select(*[F.col(theirs).alias(ours) for theirs, ours in columns.items()])
            return reconciled(ours, target, tested)

        return load

    return OrderModel(**{
        target: reader(source, target, columns) for source, (target, columns) in TABLES.items()
    })
