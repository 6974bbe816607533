"""Using an intermediate value several times within one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it.

    Without it the optimizer, pushing a filter through a chain of such steps, writes the
    steps into each other and the expression grows with every use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
