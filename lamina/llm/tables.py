"""Reading the given tables and settling intermediate ones in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one file of a table of few narrow columns should have, and the least tasks that write one.
FILE_ROWS, LEAST_TASKS = 1_000_000, 8


def settle(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write a frame below ``spark.checkpoint.dir`` and read it back.

    ``rows`` says that the frame has so many at most, of few narrow columns: then files of
    FILE_ROWS rows are written, not one of a few rows for every shuffle partition.

    This cuts the lineage with files that outlive any executor, keeps later jobs from
    computing the frame again, and gives the planner its size in bytes, so that it
    broadcasts the table only below its threshold.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, -(-rows // FILE_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
