"""The stored models, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.conform import conform, require_not_null
from lamina.operators.latest import latest_by
from lamina.plans.employees import REQUIRED, dim_employee, fct_department_summary, stg_employees
from lamina.plans.feed import normalize_feed, raw_feed
from lamina.plans.partials import add_load, summary_of
from lamina.plans.pipeline import Warehouse, employee_checks, run_pipeline
from lamina.schemas import RAW_EMPLOYEES
from lamina.session import work_dir
from lamina.sources import Table
from registered.inputs import (
    EMP_FEED_SQL,
    EMP_RAW_SQL,
    RUN_TS,
    SEGMENTS,
    emp_feed,
    emp_raw,
    given,
)
from registered.scalars import CAPITALS_SQL

STG_SQL = f"""
    select employee_id, lower(trim(first_name)) first_name, lower(trim(last_name)) last_name,
           lower(trim(email)) email, upper(trim(department)) department,
           {CAPITALS_SQL.format("trim(city)")} city,
           salary, hire_date, extracted_at, timestamp '{RUN_TS}' processed_at
    from ({EMP_RAW_SQL})
    where employee_id is not null and first_name is not null and email is not null"""

YEARS_SQL = f"extract(year from age(timestamp '{RUN_TS}', hire_date::timestamp))"

DIM_SQL = f"""
    select employee_id employee_sk, first_name, last_name, first_name || ' ' || last_name full_name,
           email, department, city, salary, hire_date, {YEARS_SQL} years_of_service,
           case when salary < 5000 then 'Junior' when salary < 10000 then 'Mid' else 'Senior' end salary_band,
           processed_at
    from ({STG_SQL})"""

FCT_SQL = f"""
    select department, count(*) employee_count,
           cast(round(avg(salary), 2) as decimal(11,2)) avg_salary,
           min(salary) min_salary, max(salary) max_salary,
           cast(round(avg({YEARS_SQL}), 1) as decimal(12,1)) avg_years_of_service,
           count(distinct city) cities_count, processed_at
    from ({STG_SQL}) group by department, processed_at"""

FEED_SQL = f"""
    select emp_id, first_name, last_name, cast(strptime(dob, '%d-%m-%Y') as date) birth_date,
           doj date_of_joining, record_date
    from (select *, row_number() over (partition by emp_id order by record_date desc nulls first, tie desc) rn
          from ({EMP_FEED_SQL}))
    where rn = 1"""


RUN_DATE = "2001-07-28"
NO_HIRE_DATE = "1990-01-01"

# The feed as the whole run takes it: without the tie column, equal dates go by the others.
RUN_FEED_SQL = f"""
    select emp_id, first_name, last_name, birth_date, date_of_joining, record_date
    from (select *, row_number() over (partition by emp_id order by record_date desc nulls first,
                 birth_date desc nulls first, date_of_joining desc nulls first,
                 first_name desc nulls first, last_name desc nulls first) rn
          from (select emp_id, first_name, last_name, cast(strptime(dob, '%d-%m-%Y') as date) birth_date,
                       doj date_of_joining, record_date
                from ({EMP_FEED_SQL})))
    where rn = 1"""


def _complete(sql: str) -> str:
    """The same over raw records with a stand-in for what some lack."""
    return sql.replace(
        EMP_RAW_SQL,
        f"""
        select * replace (coalesce(first_name, 'none') as first_name, coalesce(last_name, 'none') as last_name,
                          coalesce(hire_date, date '{NO_HIRE_DATE}') as hire_date)
        from ({EMP_RAW_SQL})""",
    )


def naive(df: DataFrame) -> DataFrame:
    """``processed_at`` as wall time, the type that the SQL side has."""
    return df.withColumn("processed_at", F.col("processed_at").cast("timestamp_ntz"))


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(stg_employees(emp_raw(spark, sf_dir), RUN_TS))


def dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(dim_employee(stg_employees(emp_raw(spark, sf_dir), RUN_TS), RUN_TS))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(fct_department_summary(stg_employees(emp_raw(spark, sf_dir), RUN_TS), RUN_TS))


def required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return require_not_null(emp_raw(spark, sf_dir), REQUIRED).select("employee_id", "last_name")


def conformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and times as ISO text and a float salary, cast to the declared types."""
    arrived = emp_raw(spark, sf_dir).withColumns(
        {
            "salary": F.col("salary").cast("double"),
            "hire_date": F.col("hire_date").cast("string"),
            "extracted_at": F.lit("2024-01-01T00:00:00"),
        }
    )
    return conform(arrived, RAW_EMPLOYEES)


def literal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three literal records and the whole feed, by position."""
    feed = emp_feed(spark, sf_dir).drop("tie")
    return raw_feed(spark).union(feed)


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(emp_feed(spark, sf_dir), ["emp_id"], "record_date", ["tie"])


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_feed(emp_feed(spark, sf_dir), ["tie"])


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one run date, text against text, the date as a query argument."""
    return spark.sql(
        "select tie, emp_id, record_date from {feed} where record_date = :run_date",
        args={"run_date": "2001-07-28"},
        feed=emp_feed(spark, sf_dir),
    )


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("employee_sk"), F.col("c_name").alias("full_name")
    )


def starred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a table and one more."""
    return given(spark, sf_dir, "orders").select("*", F.year("o_orderdate").alias("order_year"))


def inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows, for a look at the table."""
    return given(spark, sf_dir, "orders").orderBy("o_orderkey").select("o_orderkey", "o_custkey").limit(5)


def model_after_runs(model: str, runs: int = 2) -> Callable:
    """A model's rows after the whole run was made so many times, all sixteen checks passing."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = work_dir(spark, "run")
        raw, feed = complete_raw(spark, sf_dir), emp_feed(spark, sf_dir).drop("tie")
        for _ in range(runs):
            run_pipeline(
                spark, raw, base, RUN_TS, RUN_DATE, feed_df=feed, checks=employee_checks(SEGMENTS), publish_after_checks=True
            )
        rows = Warehouse(spark, base).read(model)
        return naive(rows) if "processed_at" in rows.columns else rows

    return query


def complete_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records with a stand-in for what the checks want and some records lack."""
    stand_ins = {"first_name": F.lit("none"), "last_name": F.lit("none"), "hire_date": F.lit(NO_HIRE_DATE).cast("date")}
    raw = emp_raw(spark, sf_dir)
    return raw.withColumns({c: F.coalesce(c, other) for c, other in stand_ins.items()})


def summary_of_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The department summary from partial aggregates of three loads, one of them given twice."""
    target = Table(spark, work_dir(spark, "partials"))
    raw = emp_raw(spark, sf_dir)
    loads = {
        "early": raw.where(F.col("hire_date") < "1996-01-01"),
        "late": raw.where(F.col("hire_date") >= "1996-01-01"),
        "without a date": raw.where(F.col("hire_date").isNull()),
    }
    for name in [*loads, "late"]:
        add_load(stg_employees(loads[name], RUN_TS), target, name)
    return naive(summary_of(target.read(), RUN_TS))


QUERIES = {
    "summary_of_loads": summary_of_loads,
    "stg_employees": silver,
    "dim_employee": dimension,
    "fct_department_summary": summary,
    "filter_required_columns": required,
    "conform_schema": conformed,
    "literal_union": literal_union,
    "latest_by_key": latest,
    "normalize_feed": normalized,
    "filter_run_date": filtered,
    "projection_rename": renamed,
    "projection_star": starred,
    "limit_for_inspection": inspected,
    "batch_run": model_after_runs("fct_department_summary"),
    "batch_run_dimension": model_after_runs("dim_employee"),
    "batch_run_del_ins": model_after_runs("replaced_feed"),
    "batch_run_merge_ins": model_after_runs("merged_feed"),
    "batch_run_inc_ap": model_after_runs("appended_feed"),
}

SQL = {
    "summary_of_loads": FCT_SQL,
    "stg_employees": STG_SQL,
    "dim_employee": DIM_SQL,
    "fct_department_summary": FCT_SQL,
    "filter_required_columns": f"""
        select employee_id, last_name from ({EMP_RAW_SQL})
        where employee_id is not null and first_name is not null and email is not null""",
    "conform_schema": EMP_RAW_SQL,
    "literal_union": f"""
        select 1 emp_id, 'Ron' first_name, 'Paul' last_name, '21-08-1969' dob,
               '2022-08-01 09:00:00' doj, '2022-09-01' record_date
        union all select 2, 'Ben', 'Stack', '14-04-1972', '2022-08-01 09:00:00', '2022-09-01'
        union all select 3, 'Tacy', 'Jen', '08-11-1981', '2022-08-01 09:00:00', '2022-09-01'
        union all select emp_id, first_name, last_name, dob, doj, record_date from ({EMP_FEED_SQL})""",
    "latest_by_key": f"""
        select emp_id, first_name, last_name, dob, doj, record_date, tie
        from (select *, row_number() over (partition by emp_id order by record_date desc nulls first, tie desc) rn
              from ({EMP_FEED_SQL}))
        where rn = 1""",
    "normalize_feed": FEED_SQL,
    "filter_run_date": f"""
        select tie, emp_id, record_date from ({EMP_FEED_SQL}) where record_date = '2001-07-28'""",
    "projection_rename": "select c_custkey employee_sk, c_name full_name from customer",
    "projection_star": "select *, cast(year(o_orderdate) as integer) order_year from orders",
    "limit_for_inspection": "select o_orderkey, o_custkey from orders order by o_orderkey limit 5",
    "batch_run": _complete(FCT_SQL),
    "batch_run_dimension": _complete(DIM_SQL),
    "batch_run_del_ins": RUN_FEED_SQL,
    "batch_run_merge_ins": RUN_FEED_SQL,
    "batch_run_inc_ap": f"""
        with feed as ({RUN_FEED_SQL})
        select * from feed union all select * from feed where record_date = '{RUN_DATE}'""",
}
