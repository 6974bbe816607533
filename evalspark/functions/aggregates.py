"""Small aggregate helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: str | Column) -> Column:
    """Number of rows for which the condition, a column or SQL text, holds."""
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def rate(condition: str | Column) -> Column:
    """Share of rows for which the condition holds; zero without rows."""
    flag = F.expr(condition) if isinstance(condition, str) else condition
    held = F.coalesce(flag, F.lit(False)).cast("int")
    return F.coalesce(F.avg(held), F.lit(0.0))
