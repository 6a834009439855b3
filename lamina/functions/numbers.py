"""Exact decimal averages and the salary bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.columns import as_column

# Upper bounds (exclusive) and labels of the salary bands.
MID_FROM = 5000
SENIOR_FROM = 10000
BANDS = ("Junior", "Mid", "Senior")


def exact_avg(c: Column | str, scale: int) -> Column:
    """Average of a decimal column, rounded once, half away from zero.

    The built-in average of ``decimal(10,2)`` first rounds to six places, which
    can turn a value just below a half into a half. ``sum / count`` of a
    ``decimal(10, s)`` keeps at least eighteen. Both combine before the shuffle.
    """
    c = as_column(c)
    return F.round(F.sum(c) / F.count(c), scale)


def salary_band(c: Column | str) -> Column:
    """Junior, Mid or Senior; a null salary falls through to Senior."""
    c = as_column(c)
    return F.when(c < MID_FROM, BANDS[0]).when(c < SENIOR_FROM, BANDS[1]).otherwise(BANDS[2])
