"""Scalar functions of numbers; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """As SQL rounds a double: the product with the power of ten to the nearest whole, while Spark's ``round`` goes by the shortest decimal."""
    ten = 10.0**digits
    return F.round((F.col(c) if isinstance(c, str) else c) * ten, 0) / ten
