"""Assertions over the given tables and the assertion suite over stored models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.bitmaps import distinct_numbers
from lamina.operators.checks import (
    Check,
    accepted_values,
    freshness,
    not_null,
    query_test,
    relationships,
    run_checks,
    unique,
)
from lamina.operators.violations import accepted, violations
from lamina.plans.employees import dim_employee, fct_department_summary, stg_employees
from lamina.plans.pipeline import Warehouse, employee_checks, write_table
from lamina.session import work_dir
from registered.inputs import RUN_TS, SEGMENTS, emp_raw, given
from registered.models import DIM_SQL, FCT_SQL, STG_SQL


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique(given(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_null(emp_raw(spark, sf_dir), "last_name").select("employee_id", "email")


def outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted_values(given(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = given(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return relationships(given(spark, sf_dir, "lineitem"), "l_orderkey", urgent, "o_orderkey")


def age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freshness(given(spark, sf_dir, "events"), "ts", RUN_TS, 24)


def query_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_test(
        spark,
        "select o_orderkey, o_totalprice from {orders} where o_totalprice > :most",
        {"most": 400000.0},
        orders=given(spark, sf_dir, "orders"),
    )


def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: given(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")}
    return run_checks(
        tables,
        [
            Check("unique", "lineitem", "l_orderkey"),
            Check("unique", "orders", "o_orderkey"),
            Check("not_null", "orders", "o_custkey"),
            Check("accepted_values", "orders", "o_orderstatus", ("F", "O")),
            Check("accepted_values", "lineitem", "l_returnflag", ("A", "N")),
            Check("accepted_values", "lineitem", "l_linestatus", ("O",)),
            Check("unique", "customer", "c_name"),
        ],
    )


def stored_models(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    warehouse = Warehouse(spark, work_dir(spark, "checks"))
    write_table(stg_employees(emp_raw(spark, sf_dir), RUN_TS), warehouse.table("stg_employees"))
    stg = warehouse.read("stg_employees")
    write_table(dim_employee(stg, RUN_TS), warehouse.table("dim_employee"))
    write_table(fct_department_summary(stg, RUN_TS), warehouse.table("fct_department_summary"))
    return {name: warehouse.read(name) for name in ("stg_employees", "dim_employee", "fct_department_summary")}


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen assertions on the stored tables."""
    return run_checks(stored_models(spark, sf_dir), employee_checks(SEGMENTS))


def _check_sql(test: str, model: str, column: str, table: str, values: tuple = ()) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    failures = {
        "unique": f"select count(*) from (select {column} from {table} where {column} is not null "
        f"group by {column} having count(*) > 1)",
        "not_null": f"select count(*) from {table} where {column} is null",
        "accepted_values": f"select count(distinct {column}) from {table} where {column} not in ({listed})",
    }[test]
    return f"select '{test}' test, '{model}' model, '{column}' \"column\", ({failures}) failures"


def _suite_sql(checks: list[tuple]) -> str:
    rows = " union all ".join(_check_sql(*c) for c in checks)
    return f"select *, case when failures > 0 then 'fail' else 'pass' end status from ({rows})"


_MODEL_SQL = f"""
    with stg_employees as ({STG_SQL}), dim_employee as ({DIM_SQL}), fct_department_summary as ({FCT_SQL})
"""

def full_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of check in one verdict."""
    tables = {name: given(spark, sf_dir, name) for name in ("lineitem", "orders", "customer", "events")}
    return run_checks(
        tables,
        [
            Check("unique", "lineitem", ("l_orderkey", "l_linenumber")),
            Check("unique", "lineitem", ("l_partkey", "l_suppkey")),
            Check("not_null", "lineitem", "l_shipdate"),
            Check("accepted_values", "lineitem", "l_returnflag", ("A", "N")),
            Check("accepted_values", "lineitem", "l_linestatus", ("O", "F")),
            Check("relationships", "lineitem", "l_orderkey", parent="orders", parent_column="o_orderkey"),
            Check("relationships", "customer", "c_custkey", parent="orders", parent_column="o_custkey"),
            Check("freshness", "events", "ts", run_ts=RUN_TS, max_age_hours=24),
            Check("query", "orders", sql="select o_orderkey from {orders} where o_totalprice > 400000"),
        ],
    )


FULL_SUITE_SQL = f"""
    with found as (
        select 'unique' test, 'lineitem' model, 'l_orderkey, l_linenumber' "column", (select count(*) from (
            select 1 from lineitem where l_orderkey is not null and l_linenumber is not null
            group by l_orderkey, l_linenumber having count(*) > 1)) failures
        union all select 'unique', 'lineitem', 'l_partkey, l_suppkey', (select count(*) from (
            select 1 from lineitem where l_partkey is not null and l_suppkey is not null
            group by l_partkey, l_suppkey having count(*) > 1))
        union all select 'not_null', 'lineitem', 'l_shipdate', (select count(*) from lineitem where l_shipdate is null)
        union all select 'accepted_values', 'lineitem', 'l_returnflag',
            (select count(distinct l_returnflag) from lineitem where l_returnflag not in ('A', 'N'))
        union all select 'accepted_values', 'lineitem', 'l_linestatus',
            (select count(distinct l_linestatus) from lineitem where l_linestatus not in ('O', 'F'))
        union all select 'relationships', 'lineitem', 'l_orderkey',
            (select count(distinct l_orderkey) from lineitem where l_orderkey not in (select o_orderkey from orders))
        union all select 'relationships', 'customer', 'c_custkey',
            (select count(distinct c_custkey) from customer where c_custkey not in (select o_custkey from orders))
        union all select 'freshness', 'events', 'ts',
            (select case when max(ts) >= timestamp '{RUN_TS}' - interval 25 hour + interval 1 microsecond then 0 else 1 end from events)
        union all select 'query', 'orders', '', (select count(*) from orders where o_totalprice > 400000))
    select *, case when failures > 0 then 'fail' else 'pass' end status from found"""

def inspected_orders(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], list[Check]]:
    orders = given(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date").cast("string").alias("o_orderdate")
    tables = {
        "orders": orders.select("o_orderkey", "o_custkey", "o_orderstatus", day),
        "priced": orders.select("o_orderkey", "o_totalprice"),
        "builders": given(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"),
    }
    return tables, [
        Check("not_null", "orders", "o_custkey"),
        Check("accepted_values", "orders", "o_orderstatus", ("F", "O")),
        Check("unique", "orders", ("o_custkey", "o_orderdate")),
        Check("relationships", "orders", "o_custkey", parent="builders", parent_column="c_custkey"),
        Check("query", "priced", sql="select o_orderkey from {priced} where o_totalprice > 400000"),
    ]


def violating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that breaks a check, once per check."""
    tables, checks = inspected_orders(spark, sf_dir)
    return violations(tables, checks, {"orders": ["o_orderkey"]})


def accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders that break no check."""
    tables, checks = inspected_orders(spark, sf_dir)
    return accepted(tables["orders"], [c for c in checks if c.model == "orders"], tables)


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts of the whole-number keys of orders and order lines."""
    orders = distinct_numbers(given(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")
    return orders.unionAll(distinct_numbers(given(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey"))


_INSPECTED_SQL = """
    with o as (select o_orderkey, o_custkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') o_orderdate from orders),
    t as (select *, o_orderstatus not in ('F', 'O') outside, count(*) over (partition by o_custkey, o_orderdate) > 1
              and o_custkey is not null and o_orderdate is not null again,
              o_custkey is not null and o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING') orphan,
              json_object('o_orderkey', o_orderkey)::varchar "key",
              json_object('o_orderkey', o_orderkey, 'o_custkey', o_custkey, 'o_orderstatus', o_orderstatus,
                  'o_orderdate', o_orderdate)::varchar "row" from o)"""


def _numbers_sql(table: str, column: str) -> str:
    return (
        f"select '{column}' \"column\", count({column}) \"rows\", count(distinct {column}) distinct_values, "
        f"count({column}) - count(distinct {column}) surplus, count({column}) = count(distinct {column}) is_unique from {table}"
    )


QUERIES = {
    "dq_violating_rows": violating_rows,
    "dq_accepted_rows": accepted_rows,
    "dq_distinct_numbers": numbers,
    "dq_full_suite": full_suite,
    "dq_unique": duplicates,
    "dq_not_null": nulls,
    "dq_accepted_values": outside,
    "dq_relationships": orphans,
    "dq_freshness": age,
    "dq_query_test": query_rows,
    "dq_table_checks": table_checks,
    "dq_suite": suite,
}

SQL = {
    "dq_violating_rows": f"""{_INSPECTED_SQL}
        select 'not_null' test, 'orders' model, 'o_custkey' "column", '{{"o_custkey":null}}' "value", "key", "row" from t
        where o_custkey is null
        union all select 'accepted_values', 'orders', 'o_orderstatus', json_object('o_orderstatus', o_orderstatus)::varchar,
            "key", "row" from t where outside
        union all select 'unique', 'orders', 'o_custkey, o_orderdate',
            json_object('o_custkey', o_custkey, 'o_orderdate', o_orderdate)::varchar, "key", "row" from t where again
        union all select 'relationships', 'orders', 'o_custkey', json_object('o_custkey', o_custkey)::varchar, "key", "row"
        from t where orphan
        union all select 'query', 'priced', '', null, null, json_object('o_orderkey', o_orderkey)::varchar from orders
        where o_totalprice > 400000""",
    "dq_accepted_rows": f"""{_INSPECTED_SQL}
        select o_orderkey, o_custkey, o_orderstatus, o_orderdate from t
        where o_custkey is not null and not coalesce(outside, false) and not again and not orphan""",
    "dq_distinct_numbers": " union all ".join(
        _numbers_sql(*of)
        for of in (("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"))
    ),
    "dq_full_suite": FULL_SUITE_SQL,
    "dq_unique": """
        select l_orderkey, l_linenumber, count(*) occurrences from lineitem
        where l_orderkey is not null and l_linenumber is not null
        group by l_orderkey, l_linenumber having count(*) > 1""",
    "dq_not_null": """
        select cast(c_custkey as varchar) employee_id, c_name || '@EMPRESA.com ' email
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where c_custkey % 89 = 0""",
    "dq_accepted_values": """
        select o_orderstatus, count(*) occurrences from orders
        where o_orderstatus not in ('F', 'O') group by o_orderstatus""",
    "dq_relationships": """
        select l_orderkey, count(*) occurrences from lineitem
        where l_orderkey is not null
          and not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderpriority = '1-URGENT')
        group by l_orderkey""",
    "dq_freshness": f"""
        select max(ts) max_loaded_at, date_sub('hour', max(ts), timestamp '{RUN_TS}') age_hours,
               case when date_sub('hour', max(ts), timestamp '{RUN_TS}') <= 24 then 'pass' else 'fail' end status
        from events""",
    "dq_query_test": "select o_orderkey, o_totalprice from orders where o_totalprice > 400000.0",
    "dq_table_checks": _suite_sql(
        [
            ("unique", "lineitem", "l_orderkey", "lineitem"),
            ("unique", "orders", "o_orderkey", "orders"),
            ("not_null", "orders", "o_custkey", "orders"),
            ("accepted_values", "orders", "o_orderstatus", "orders", ("F", "O")),
            ("accepted_values", "lineitem", "l_returnflag", "lineitem", ("A", "N")),
            ("accepted_values", "lineitem", "l_linestatus", "lineitem", ("O",)),
            ("unique", "customer", "c_name", "customer"),
        ]
    ),
    "dq_suite": _MODEL_SQL
    + _suite_sql([(c.test, c.model, c.column, c.model, c.values) for c in employee_checks(SEGMENTS)]),
}
