"""The department summary kept up to date by partial aggregates of each load.

A load's rows are summed up per department, city and hire date: counts, the exact sum of
salaries, least and greatest salary. Such partials add up in any order, so a new load is
read once and earlier rows are never read again. Cities can be counted because each has its
own partial, and years of service for any run time because each hire date has.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import run_timestamp, whole_years
from lamina.schemas import FCT_DEPARTMENT_SUMMARY, require_schema
from lamina.sources.table import Snapshot, Table

BY = ["department", "city", "hire_date"]
#: Loads of partials that are kept side by side before they are added up.
FOLD = 16


def partials_of(stg: DataFrame) -> DataFrame:
    """The partials of some silver rows."""
    return stg.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("employees"),
        F.count("salary").alias("salaries"),
        F.sum(F.col("salary").cast("decimal(10,2)")).alias("salary_sum"),
        F.min("salary").alias("min_salary"),
        F.max("salary").alias("max_salary"),
    )


def added(partials: DataFrame) -> DataFrame:
    """One partial per department, city and hire date of several."""
    return partials.groupBy(*BY).agg(
        F.sum("employees").alias("employees"),
        F.sum("salaries").alias("salaries"),
        F.sum("salary_sum").cast("decimal(20,2)").alias("salary_sum"),
        F.min("min_salary").alias("min_salary"),
        F.max("max_salary").alias("max_salary"),
    )


def add_load(stg: DataFrame, target: Table, load: str) -> Snapshot:
    """Store a load's partials under its name; a load that is there already adds nothing.

    Every FOLD loads the stored partials are added up, so their number does not grow with the loads.
    """
    before = target.snapshot()
    if before is not None and load in before.marks:
        return before
    if before is None:
        first = target.overwrite(partials_of(stg), publish=False)
        return target.publish(target.marked(first, {load: 1}))
    made = target.append(partials_of(stg), marks={load: 1})
    return target.overwrite(added(target.read(made))) if len(made.parts) > FOLD else made


def summary_of(partials: DataFrame, run_ts: datetime | str) -> DataFrame:
    """The department summary at a run time, equal to that of all rows behind the partials."""
    years = whole_years(run_timestamp(run_ts), "hire_date").cast("decimal(10,0)")
    dated = F.when(F.col("hire_date").isNotNull(), F.col("employees"))
    summary = partials.groupBy("department").agg(
        F.sum("employees").alias("employee_count"),
        # The total in the type that a sum of the rows has, so that the quotient rounds alike.
        F.round(F.sum("salary_sum").cast("decimal(20,2)") / F.sum("salaries"), 2).cast("decimal(11,2)").alias("avg_salary"),
        F.min("min_salary").alias("min_salary"),
        F.max("max_salary").alias("max_salary"),
        F.round(F.sum(years * dated).cast("decimal(20,0)") / F.sum(dated), 1)
        .cast("decimal(12,1)")
        .alias("avg_years_of_service"),
        F.count_distinct("city").alias("cities_count"),
    )
    columns = summary.withColumn("processed_at", run_timestamp(run_ts)).select(FCT_DEPARTMENT_SUMMARY.names)
    return require_schema(columns, FCT_DEPARTMENT_SUMMARY)
