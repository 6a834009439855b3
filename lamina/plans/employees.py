"""The employee tables: silver cleaning, gold dimension, gold department summary."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import (
    clean_lower,
    clean_upper,
    exact_avg,
    full_name,
    initcap_words,
    run_timestamp,
    salary_band,
    whole_years,
)
from lamina.operators.conform import require_not_null
from lamina.schemas import (
    DIM_EMPLOYEE,
    FCT_DEPARTMENT_SUMMARY,
    MONEY,
    STG_EMPLOYEES,
    require_schema,
)

REQUIRED = ["employee_id", "first_name", "email"]


def stg_employees(raw: DataFrame, run_ts: datetime | str) -> DataFrame:
    """Raw employees with the required columns, in standard spelling and types.

    Required columns are tested before trimming, so blanks pass. One narrow stage.
    """
    cleaned = require_not_null(raw, REQUIRED).select(
        "employee_id",
        clean_lower("first_name").alias("first_name"),
        clean_lower("last_name").alias("last_name"),
        clean_lower("email").alias("email"),
        clean_upper("department").alias("department"),
        initcap_words(F.trim("city")).alias("city"),
        F.col("salary").cast(MONEY).alias("salary"),
        F.col("hire_date").cast("date").alias("hire_date"),
        "extracted_at",
        run_timestamp(run_ts).alias("processed_at"),
    )
    return require_schema(cleaned, STG_EMPLOYEES)


def dim_employee(stg: DataFrame, run_ts: datetime | str) -> DataFrame:
    """One row per employee with full name, years of service and salary band.

    One narrow stage. ``processed_at`` is the silver build's.
    """
    dimension = stg.select(
        F.col("employee_id").alias("employee_sk"),
        "first_name",
        "last_name",
        full_name("first_name", "last_name").alias("full_name"),
        "email",
        "department",
        "city",
        "salary",
        "hire_date",
        whole_years(run_timestamp(run_ts), "hire_date").alias("years_of_service"),
        salary_band("salary").alias("salary_band"),
        "processed_at",
    )
    return require_schema(dimension, DIM_EMPLOYEE)


def fct_department_summary(
    stg: DataFrame, run_ts: datetime | str, approximate_cities: bool = False
) -> DataFrame:
    """Counts, salary figures, service and cities per department and silver build.

    The rows of a department combine per city before the first shuffle and per
    department before the second, so few rows move whatever the input's size.
    ``approximate_cities=True`` estimates the cities and saves the first shuffle.
    """
    cities = F.approx_count_distinct("city") if approximate_cities else F.count_distinct("city")
    years = whole_years(run_timestamp(run_ts), "hire_date").cast("decimal(10,0)")
    summary = (
        stg.groupBy("department", "processed_at")
        .agg(
            F.count(F.lit(1)).alias("employee_count"),
            exact_avg("salary", 2).cast("decimal(11,2)").alias("avg_salary"),
            F.min("salary").alias("min_salary"),
            F.max("salary").alias("max_salary"),
            exact_avg(years, 1).cast("decimal(12,1)").alias("avg_years_of_service"),
            cities.alias("cities_count"),
        )
        .select(FCT_DEPARTMENT_SUMMARY.names)
    )
    return require_schema(summary, FCT_DEPARTMENT_SUMMARY)
