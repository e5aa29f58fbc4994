"""Column functions: geometry, text and small helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), 0)


def not_in(column: Column, values: tuple[str, ...] | list[str]) -> Column:
    """Whether the value isn't listed; nulls aren't."""
    return ~F.coalesce(column.isin(*values), F.lit(False))


def null_for_nan(column: Column) -> Column:
    return F.when(~F.isnan(column), column)
