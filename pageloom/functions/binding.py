"""Name an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A plain Python variable would paste the expression into every use; inside a
    higher-order function it would also be recomputed per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
