"""Exact distinct counts of whole numbers by bitmaps.

A number's bit lies in a bitmap of 32,768 bits (4 KB) of its range. Tasks set bits for the rows
that they read and pass on one bitmap per range, so what is shuffled follows the ranges that
a task meets, not its rows: for keys that are stored nearly in order, as generated keys are,
a small part of what grouping by the key moves. Keys scattered over a range that is wide
against a task's rows are better grouped; the results are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_bitmaps(df: DataFrame, column: str) -> DataFrame:
    """``bucket, bits, n``: per range the numbers that occur, and how many rows hold them. Nulls do not count."""
    number = F.col(column).cast("long")
    return (
        df.where(F.col(column).isNotNull())
        .select(F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("position"))
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("position").alias("bits"), F.count(F.lit(1)).alias("n"))
    )


def distinct_numbers(df: DataFrame, *columns: str) -> DataFrame:
    """Per column its rows with a value, different values, surplus rows, and whether it is unique.

    The surplus are the rows beyond the first of each value.
    """
    out = None
    for column in columns:
        counts = range_bitmaps(df, column).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("distinct_values"),
        )
        row = counts.select(
            F.lit(column).alias("column"),
            "rows",
            "distinct_values",
            (F.col("rows") - F.col("distinct_values")).alias("surplus"),
            (F.col("rows") == F.col("distinct_values")).alias("is_unique"),
        )
        out = row if out is None else out.unionAll(row)
    return out
