"""Dates: strict parsing, the run time literal, elapsed calendar years."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.columns import as_column


def run_timestamp(run_ts: datetime | str) -> Column:
    """One build's time as a literal.

    ``current_timestamp()`` would be evaluated again by every query over the
    same plan. A value without a zone is wall time of the session's zone.
    """
    if isinstance(run_ts, datetime) and run_ts.tzinfo is not None:
        return F.lit(run_ts)
    return F.lit(str(run_ts)).cast("timestamp")


def parse_date(c: Column | str, pattern: str = "d-M-yyyy", on_error: str = "raise") -> Column:
    """Date from text. One- and two-digit days and months are read.

    An impossible date raises or, with ``on_error="null"``, gives null.
    """
    c = as_column(c)
    parsed = F.try_to_date(c, pattern)
    if on_error == "null":
        return parsed
    if on_error != "raise":
        raise ValueError(f"on_error must be 'raise' or 'null', not {on_error!r}")
    return F.coalesce(parsed, F.when(c.isNotNull(), F.raise_error(F.concat(F.lit("not a date: "), c))))


def whole_years(later: Column | str, earlier: Column | str) -> Column:
    """Full calendar years from ``earlier`` to ``later``, as bigint.

    The year difference, less one when the later moment's place in its year
    (month, day, time of day) lies before the earlier one's. Dates count from
    midnight. With the arguments the other way round in time, the same number
    comes out negative.
    """
    a = as_column(later).cast("timestamp_ntz")
    b = as_column(earlier).cast("timestamp_ntz")
    unfinished = F.when(
        a >= b,
        F.when(_earlier_in_year(a, b), -1).otherwise(0),
    ).otherwise(F.when(_earlier_in_year(b, a), 1).otherwise(0))
    return (F.year(a) - F.year(b) + unfinished).cast("bigint")


def _earlier_in_year(a: Column, b: Column) -> Column:
    """Whether ``a`` lies before ``b`` within the year; the time counts on equal days only."""
    return (_day(a) < _day(b)) | ((_day(a) == _day(b)) & (_seconds(a) < _seconds(b)))


def _day(c: Column) -> Column:
    return F.month(c) * 100 + F.dayofmonth(c)


def _seconds(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("SECOND"), c)
