"""Order-management and HR reports as PySpark DataFrame functions."""

from orderboard.model import OrderModel

__all__ = ["OrderModel"]
