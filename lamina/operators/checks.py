"""Assertions on stored tables. Each returns its violations; none means pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.dates import run_timestamp
from lamina.operators.conform import require_not_null


def unique(df: DataFrame, *columns: str) -> DataFrame:
    """Values that occur more than once, with their count. Nulls do not count."""
    counted = require_not_null(df, list(columns)).groupBy(*columns)
    return counted.agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")


def not_null(df: DataFrame, column: str) -> DataFrame:
    """Rows without a value."""
    return df.where(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list, with their count. Null passes."""
    outside = df.where(~F.col(column).isin(list(values)))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences"))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values with no row in the parent, with their count. Nulls do not count.

    Counting comes before the join, so each value crosses once however often it
    occurs.
    """
    values = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
    return values.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")


def freshness(df: DataFrame, column: str, run_ts: datetime | str, max_age_hours: int) -> DataFrame:
    """One row: the newest ``column``, its whole hours of age, and pass or fail.

    A table without rows fails.
    """
    newest = F.col("max_loaded_at")
    hours = F.timestamp_diff("HOUR", newest, run_timestamp(run_ts).cast("timestamp_ntz"))
    passed = F.coalesce(F.col("age_hours") <= max_age_hours, F.lit(False))
    return (
        df.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("max_loaded_at"))
        .withColumn("age_hours", hours)
        .withColumn("status", F.when(passed, "pass").otherwise("fail"))
    )


def query_test(spark: SparkSession, sql: str, args: Mapping | None = None, **tables: DataFrame) -> DataFrame:
    """The rows of a query that should return none; it names ``tables`` in braces."""
    return spark.sql(sql, args=dict(args or {}), **tables)


KINDS = ("unique", "not_null", "accepted_values", "relationships", "freshness", "query")


@dataclass(frozen=True)
class Check:
    """One assertion on one table.

    ``column`` names one column, for ``unique`` also several. ``relationships`` looks
    for the values in ``parent_column`` of the table ``parent``; ``freshness`` wants the
    newest value at most ``max_age_hours`` before ``run_ts``; ``query`` names tables in
    braces in ``sql`` and should return no row.
    """

    test: str
    model: str
    column: str | tuple[str, ...] = ""
    values: tuple = ()
    parent: str = ""
    parent_column: str = ""
    run_ts: datetime | str = ""
    max_age_hours: int = 0
    sql: str = ""

    def __post_init__(self):
        if self.test not in KINDS:
            raise ValueError(f"unknown test {self.test!r}")
        if self.test != "unique" and not isinstance(self.column, str):
            raise ValueError(f"{self.test} takes one column")

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,) if isinstance(self.column, str) else tuple(self.column)

    @property
    def tables(self) -> tuple[str, ...]:
        """The names that the check reads."""
        return (self.model, self.parent) if self.parent else (self.model,)


class ChecksFailed(AssertionError):
    """At least one assertion found violations."""


def run_checks(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """All checks as one query: test, model, column, failures, status.

    ``failures`` counts what the single check would return: duplicated values, null
    rows, distinct values outside the list or without a parent, stale tables, rows of
    a query. The null checks of a table share one scan; each other check groups its own
    column. No checks, no rows.
    """
    results = []
    for model in dict.fromkeys(c.model for c in checks):
        own = [c for c in checks if c.model == model]
        nulls = [c for c in own if c.test == "not_null"]
        if nulls:
            results.append(_null_counts(tables[model], nulls))
        results += [_violations(tables, c) for c in own if c.test != "not_null"]
    if not results:
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([], "test string, model string, column string, failures bigint, status string")
    status = F.when(F.col("failures") > 0, "fail").otherwise("pass")
    return reduce(DataFrame.unionAll, results).withColumn("status", status)


def assert_checks(results: DataFrame) -> None:
    """Raise with the failed checks of a ``run_checks`` result, one row per check."""
    failed = results.where("failures > 0").collect()
    if failed:
        lines = [f"{r.test}({r.model}.{r.column}): {r.failures}" for r in failed]
        raise ChecksFailed("; ".join(sorted(lines)))


def _null_counts(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    counts = [F.count_if(F.col(c.column).isNull()).alias(f"f{i}") for i, c in enumerate(checks)]
    rows = [F.struct(*_labels(c), F.col(f"f{i}").alias("failures")) for i, c in enumerate(checks)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def _violations(tables: Mapping[str, DataFrame], check: Check) -> DataFrame:
    df = tables[check.model]
    if check.test == "unique":
        found = unique(df, *check.columns)
    elif check.test == "accepted_values":
        found = accepted_values(df, check.column, check.values)
    elif check.test == "relationships":
        found = relationships(df, check.column, tables[check.parent], check.parent_column)
    elif check.test == "freshness":
        found = freshness(df, check.column, check.run_ts, check.max_age_hours).where("status = 'fail'")
    else:
        found = df.sparkSession.sql(check.sql, **tables)
    return found.agg(F.count(F.lit(1)).alias("failures")).select(*_labels(check), "failures")


def _labels(check: Check) -> list[Column]:
    return [
        F.lit(check.test).alias("test"),
        F.lit(check.model).alias("model"),
        F.lit(", ".join(check.columns)).alias("column"),
    ]
