"""The incremental writers, first runs and reruns, read back from the stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.incremental import append_incremental, delete_insert, merge_upsert
from lamina.plans.feed import normalize_feed
from lamina.session import work_dir
from lamina.sources import Table
from registered.inputs import EMP_FEED_SQL, emp_feed, given
from registered.models import FEED_SQL

SPLIT = "2000-01-01"
RUN_DATE = "2001-07-28"


def early(feed: DataFrame) -> DataFrame:
    return feed.where(F.col("record_date") < SPLIT)


def late(feed: DataFrame) -> DataFrame:
    """The rest, rows without a date included: they win over any date."""
    return feed.where((F.col("record_date") >= SPLIT) | F.col("record_date").isNull())


def _upsert(write: Callable, runs: int) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        feed = emp_feed(spark, sf_dir)
        target = Table(spark, work_dir(spark, "upsert"), key="emp_id")
        write(normalize_feed(early(feed), ["tie"]), target)
        for _ in range(runs):
            write(normalize_feed(late(feed), ["tie"]), target)
        return target.read()

    return query


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line of the later orders replaces the earlier lines of its part."""
    lines = given(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("l_shipdate")
    )
    target = Table(spark, work_dir(spark, "lines"), key="l_partkey")
    delete_insert(lines.where("l_shipdate < '1999-01-01'"), target)
    delete_insert(lines.where("l_shipdate is null or l_shipdate >= '1999-01-01'"), target)
    return target.read()


def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key are added on every run."""
    rows = given(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")).alias("k"), "o_custkey"
    )
    target = Table(spark, work_dir(spark, "null-keys"), key="k")
    for _ in range(2):
        merge_upsert(rows, target)
    return target.read()


def _append(runs: int, idempotent: bool = False) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        feed = normalize_feed(emp_feed(spark, sf_dir), ["tie"])
        target = Table(spark, work_dir(spark, "append"))
        for _ in range(runs):
            append_incremental(feed, target, "record_date", RUN_DATE, idempotent)
        return target.read()

    return query


def _latest_sql(condition: str) -> str:
    return FEED_SQL.replace(f"from ({EMP_FEED_SQL})", f"from ({EMP_FEED_SQL}) where {condition}")


_EARLY = _latest_sql(f"record_date < '{SPLIT}'")
_LATE = _latest_sql(f"record_date is null or record_date >= '{SPLIT}'")
_UPSERT_SQL = f"""
    with old as ({_EARLY}), batch as ({_LATE})
    select * from old where emp_id not in (select emp_id from batch)
    union all select * from batch"""

QUERIES = {
    "delete_insert": _upsert(delete_insert, 1),
    "delete_insert_rerun": _upsert(delete_insert, 2),
    "delete_insert_duplicate_keys": duplicate_keys,
    "merge_upsert": _upsert(merge_upsert, 1),
    "merge_upsert_rerun": _upsert(merge_upsert, 2),
    "merge_upsert_null_keys": null_keys,
    "append_first_run": _append(1),
    "append_rerun": _append(2),
    "append_idempotent": _append(3, idempotent=True),
}

SQL = {
    "delete_insert": _UPSERT_SQL,
    "delete_insert_rerun": _UPSERT_SQL,
    "delete_insert_duplicate_keys": """
        with lines as (select l_partkey, l_orderkey, l_linenumber, cast(l_shipdate as date) l_shipdate from lineitem),
             batch as (select * from lines where l_shipdate is null or l_shipdate >= date '1999-01-01')
        select * from lines
        where l_shipdate < date '1999-01-01' and l_partkey not in (select l_partkey from batch)
        union all select * from batch""",
    "merge_upsert": _UPSERT_SQL,
    "merge_upsert_rerun": _UPSERT_SQL,
    "merge_upsert_null_keys": """
        select case when o_orderkey % 3 <> 0 then o_orderkey end k, o_custkey from orders
        union all select null, o_custkey from orders where o_orderkey % 3 = 0""",
    "append_first_run": FEED_SQL,
    "append_rerun": f"""
        with feed as ({FEED_SQL})
        select * from feed union all select * from feed where record_date = '{RUN_DATE}'""",
    "append_idempotent": FEED_SQL,
}
