"""Scalar expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import (
    clean_lower,
    clean_upper,
    exact_avg,
    full_name,
    initcap_words,
    parse_date,
    salary_band,
    whole_years,
)
from registered.inputs import EMP_FEED_SQL, EMP_RAW_SQL, emp_feed, emp_raw, given

# The sharp s has no simple capital; DuckDB's upper() gives it one.
CAPITALS_SQL = (
    r"array_to_string(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+'), "
    r"lambda w: case when w[1] = 'ß' then w[1] else upper(w[1]) end || lower(w[2:])), '')"
)


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emp_raw(spark, sf_dir).select(
        "employee_id",
        clean_lower("first_name").alias("first_name"),
        clean_lower("email").alias("email"),
        clean_upper("department").alias("department"),
    )


def concat_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emp_raw(spark, sf_dir).select(
        "employee_id", full_name("first_name", "last_name").alias("full_name")
    )


def initcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "documents").select(
        "doc_id", initcap_words(F.trim("text")).alias("capitalized")
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emp_feed(spark, sf_dir).select("tie", parse_date("dob").alias("birth_date"))


def dates_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        given(spark, sf_dir, "orders")
        .select("o_orderkey", F.concat_ws("-", F.col("o_orderkey") % 40, F.col("o_custkey") % 14, F.lit("2001")).alias("t"))
        .select("o_orderkey", parse_date("t", on_error="null").alias("parsed"))
    )


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    noon = F.lit("2000-02-29 12:00:00").cast("timestamp_ntz")
    return (
        given(spark, sf_dir, "orders")
        .join(given(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            whole_years(noon, "o_orderdate").alias("until_noon"),
            whole_years("o_orderdate", noon).alias("since_noon"),
            whole_years(F.lit("2026-01-01 00:00:00").cast("timestamp"), F.col("o_orderdate").cast("date")).alias(
                "until_run"
            ),
        )
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emp_raw(spark, sf_dir).select(
        "employee_id", "salary", salary_band("salary").alias("salary_band")
    )


def averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    return (
        given(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            exact_avg(price, 2).cast("decimal(11,2)").alias("avg_price"),
            exact_avg(F.col("l_linenumber").cast("decimal(10,0)"), 1).cast("decimal(12,1)").alias("avg_line"),
            F.count(F.lit(1)).alias("n"),
        )
    )


QUERIES = {
    "scalar_clean_text": clean_text,
    "scalar_full_name": concat_name,
    "scalar_initcap_words": initcap,
    "scalar_parse_date": dates,
    "scalar_parse_date_or_null": dates_or_null,
    "scalar_whole_years": years,
    "scalar_salary_band": bands,
    "exact_decimal_average": averages,
}

SQL = {
    "scalar_clean_text": f"""
        select employee_id, lower(trim(first_name)) first_name, lower(trim(email)) email,
               upper(trim(department)) department
        from ({EMP_RAW_SQL})""",
    "scalar_full_name": f"""
        select employee_id, first_name || ' ' || last_name full_name from ({EMP_RAW_SQL})""",
    "scalar_initcap_words": f"""
        select doc_id, {CAPITALS_SQL.format("trim(text)")} capitalized from documents""",
    "scalar_parse_date": f"""
        select tie, cast(strptime(dob, '%d-%m-%Y') as date) birth_date from ({EMP_FEED_SQL})""",
    "scalar_parse_date_or_null": """
        select o_orderkey,
               cast(try_strptime((o_orderkey % 40) || '-' || (o_custkey % 14) || '-2001', '%d-%m-%Y') as date) parsed
        from orders""",
    "scalar_whole_years": """
        select o_orderkey,
               extract(year from age(timestamp '2000-02-29 12:00:00', o_orderdate)) until_noon,
               extract(year from age(o_orderdate, timestamp '2000-02-29 12:00:00')) since_noon,
               extract(year from age(timestamp '2026-01-01 00:00:00', cast(o_orderdate as date)::timestamp)) until_run
        from orders join customer on o_custkey = c_custkey""",
    "scalar_salary_band": f"""
        select employee_id, salary,
               case when salary < 5000 then 'Junior' when salary < 10000 then 'Mid' else 'Senior' end salary_band
        from ({EMP_RAW_SQL})""",
    "exact_decimal_average": """
        select l_returnflag, l_linestatus,
               cast(round(sum(cast(l_extendedprice as decimal(10,2)))::decimal(28,10) / count(*), 2) as decimal(11,2)) avg_price,
               cast(round(avg(l_linenumber), 1) as decimal(12,1)) avg_line,
               count(*) n
        from lineitem group by all""",
}
