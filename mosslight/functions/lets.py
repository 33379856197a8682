"""Evaluate-once bindings for native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimiser inlines a projected column that is referenced once, also into the lambda
    of a higher-order function, where it would be evaluated once per element. A lambda
    variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
