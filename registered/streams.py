"""Streams over the given files, drained and read back from the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.session import work_dir
from lamina.sources import Table
from lamina.streaming.streams import land_stream, merge_stream
from registered.inputs import given

LANDED = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.VarcharType(40)),
        T.StructField("value", T.DecimalType(18, 2)),
    ]
)


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # As a glob, the path may be one file or a folder of files.
    return spark.readStream.schema(given(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "landing")
    target = Table(spark, f"{base}/table")
    land_stream(arriving(spark, sf_dir, "events"), target, LANDED, f"{base}/checkpoint").awaitTermination()
    return target.read()


def landing_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as CSV files of text, landed with the declared types, then compacted."""
    base = work_dir(spark, "landing-csv")
    columns = [f.name for f in LANDED]
    given(spark, sf_dir, "events").select(columns).write.option("header", True).csv(f"{base}/in")
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    target = Table(spark, f"{base}/table")
    stream = spark.readStream.schema(text).option("header", True).csv(f"{base}/in")
    land_stream(stream, target, LANDED, f"{base}/checkpoint").awaitTermination()
    return target.read(target.compact())


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = work_dir(spark, "changes")
    target = Table(spark, f"{base}/table", key="o_custkey")
    stream = arriving(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderstatus"
    )
    merge_stream(stream, target, "o_orderdate", ["o_orderkey"], f"{base}/checkpoint").awaitTermination()
    return target.read()


QUERIES = {"landing_stream": landing, "landing_csv_stream": landing_csv, "change_merge_stream": changes}

SQL = {
    "landing_stream": """
        select event_id, user_id, event_type, cast(value as decimal(18,2)) "value" from events""",
    "landing_csv_stream": """
        select event_id, user_id, event_type, cast(value as decimal(18,2)) "value" from events""",
    "change_merge_stream": """
        select o_custkey, o_orderkey, cast(o_orderdate as date) o_orderdate, o_orderstatus
        from orders
        qualify row_number() over (partition by o_custkey order by cast(o_orderdate as date) desc nulls first,
                                   o_orderkey desc nulls first) = 1""",
}
