"""Binding an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often `body` uses it.

    Spark shares equal subexpressions only outside of conditions; inside them an expression
    that is used several times is evaluated several times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
