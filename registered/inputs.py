"""The given tables in the shapes of the employee and feed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources import Source, read_source

RUN_TS = "2026-01-01 00:00:00"

# The market segments stand in for the departments.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


# The given tables as they are stored.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = Source(name, T.StructType.fromDDL(GIVEN[name]), f"{sf_dir}/{name}.parquet")
    return read_source(spark, source)


def emp_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw employee records; those without an order have no hire date."""
    customer = given(spark, sf_dir, "customer")
    nation = given(spark, sf_dir, "nation")
    region = given(spark, sf_dir, "region")
    first_order = (
        given(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.min("o_orderdate").alias("h"))
    )
    segment = F.col("c_mktsegment")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(first_order, "c_custkey", "left")
        .select(
            F.col("c_custkey").cast("string").alias("employee_id"),
            F.when(F.col("c_custkey") % 97 != 0, F.concat(F.lit(" "), F.upper(segment), F.lit(" "))).alias(
                "first_name"
            ),
            F.when(F.col("c_custkey") % 89 != 0, F.col("c_name")).alias("last_name"),
            F.concat("c_name", F.lit("@EMPRESA.com ")).alias("email"),
            F.concat(F.lit(" "), F.lower(segment)).alias("department"),
            F.concat(F.lower("n_name"), F.lit("-"), F.lower("r_name")).alias("city"),
            (F.col("c_acctbal").cast("decimal(10,2)") + 5000).cast("decimal(10,2)").alias("salary"),
            F.col("h").cast("date").alias("hire_date"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("extracted_at"),
        )
    )


EMP_RAW_SQL = """
    select cast(c_custkey as varchar) employee_id,
           case when c_custkey % 97 <> 0 then ' ' || upper(c_mktsegment) || ' ' end first_name,
           case when c_custkey % 89 <> 0 then c_name end last_name,
           c_name || '@EMPRESA.com ' email,
           ' ' || lower(c_mktsegment) department,
           lower(n_name) || '-' || lower(r_name) city,
           cast(cast(c_acctbal as decimal(10,2)) + 5000 as decimal(10,2)) salary,
           cast(h as date) hire_date,
           timestamp '2024-01-01 00:00:00' extracted_at
    from customer
    join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey
    left join (select o_custkey, min(o_orderdate) h from orders group by o_custkey) on o_custkey = c_custkey
"""


def emp_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as feed records: several per employee, some without a record date."""
    when = F.col("o_orderdate")
    return given(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("int").alias("emp_id"),
        F.col("o_orderpriority").alias("first_name"),
        F.col("o_orderstatus").alias("last_name"),
        F.date_format(when, "dd-MM-yyyy").alias("dob"),
        F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("doj"),
        F.when(F.col("o_orderkey") % 211 != 0, F.date_format(when, "yyyy-MM-dd")).alias("record_date"),
        F.col("o_orderkey").alias("tie"),
    )


EMP_FEED_SQL = """
    select cast(o_custkey as integer) emp_id,
           o_orderpriority first_name,
           o_orderstatus last_name,
           strftime(o_orderdate, '%d-%m-%Y') dob,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') doj,
           case when o_orderkey % 211 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end record_date,
           o_orderkey tie
    from orders
"""
