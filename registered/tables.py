"""Stored tables: bronze load, rebuild, source and seed reads, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.history import history_table, record_history
from lamina.plans.employees import dim_employee, stg_employees
from lamina.plans.pipeline import Warehouse, overwrite_load, write_table
from lamina.session import work_dir
from lamina.sources import Source, read_seed, read_source
from registered.inputs import EMP_RAW_SQL, RUN_TS, emp_raw, given
from registered.models import DIM_SQL, naive

ORDERS = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
    ]
)

SEED = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.VarcharType(40)),
        T.StructField("c_acctbal", T.DecimalType(12, 2)),
    ]
)


def declared_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_source(spark, Source("orders", ORDERS, f"{sf_dir}/orders.parquet"))


def bronze_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = Warehouse(spark, work_dir(spark, "bronze")).table("raw_employees")
    for _ in range(2):
        overwrite_load(emp_raw(spark, sf_dir), bronze)
    return bronze.read()


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model built from the stored rows of the one before it."""
    warehouse = Warehouse(spark, work_dir(spark, "rebuild"))
    write_table(stg_employees(emp_raw(spark, sf_dir), RUN_TS), warehouse.table("stg_employees"))
    for _ in range(2):
        write_table(dim_employee(warehouse.read("stg_employees"), RUN_TS), warehouse.table("dim_employee"))
    return naive(warehouse.read("dim_employee"))


def seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "seed")
    given(spark, sf_dir, "customer").select(*SEED.names).write.csv(path, header=True)
    return read_seed(spark, path, SEED)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last order status, recorded at two moments."""
    orders = given(spark, sf_dir, "orders")
    target = history_table(spark, work_dir(spark, "history"), ["c"])
    for run_ts, seen in (("2000-01-01 00:00:00", orders.where("o_orderdate < '2000-01-01'")), (RUN_TS, orders)):
        status = seen.groupBy(F.col("o_custkey").alias("c")).agg(
            F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status")
        )
        record_history(status, target, ["c"], run_ts)
    return target.read().select(
        "c",
        "status",
        F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
        F.col("valid_to").cast("timestamp_ntz").alias("valid_to"),
    )


_STATUS_SQL = """
    select o_custkey c, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) status
    from orders where {0} group by o_custkey"""

QUERIES = {
    "read_declared_source": declared_source,
    "bronze_overwrite_load": bronze_twice,
    "table_rebuild": rebuilt,
    "seed_csv": seed,
    "snapshot_history": history,
}

SQL = {
    "read_declared_source": "select o_orderkey, o_orderstatus, o_orderdate from orders",
    "bronze_overwrite_load": EMP_RAW_SQL,
    "table_rebuild": DIM_SQL,
    "seed_csv": "select c_custkey, c_name, cast(c_acctbal as decimal(12,2)) c_acctbal from customer",
    "snapshot_history": f"""
        with was as ({_STATUS_SQL.format("o_orderdate < timestamp '2000-01-01 00:00:00'")}),
             now_ as ({_STATUS_SQL.format("true")})
        select was.c, was.status, timestamp '2000-01-01 00:00:00' valid_from,
               case when was.status <> now_.status then timestamp '{RUN_TS}' end valid_to
        from was join now_ on was.c = now_.c
        union all
        select now_.c, now_.status, timestamp '{RUN_TS}', null
        from now_ left join was on was.c = now_.c
        where was.c is null or was.status <> now_.status""",
}
