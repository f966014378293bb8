"""Codes to display labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Payment codes and the labels reports show for them.
PAYMENT_LABELS = {
    "E": "EFECTIVO",
    "C": "CREDITO",
}
OTHER_PAYMENT = "OTRO"


def label_codes(code: Column, labels: Mapping[str, str], default: str) -> Column:
    """Label of a code; unknown codes and NULL take the default."""
    result = F.lit(default)
    for value, label in labels.items():
        result = F.when(code == F.lit(value), F.lit(label)).otherwise(result)
    return result
