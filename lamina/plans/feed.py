"""The demonstration feed: three literal records and their normal form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import parse_date
from lamina.operators.latest import latest_by
from lamina.schemas import FEED, RAW_FEED, require_schema
from lamina.sources.read import literal_rows

# The feed's records and the date the append filters on.
RAW_FEED_ROWS = [
    (1, "Ron", "Paul", "21-08-1969", "2022-08-01 09:00:00", "2022-09-01"),
    (2, "Ben", "Stack", "14-04-1972", "2022-08-01 09:00:00", "2022-09-01"),
    (3, "Tacy", "Jen", "08-11-1981", "2022-08-01 09:00:00", "2022-09-01"),
]
EXECUTION_DATE = "2022-09-01"


def raw_feed(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, RAW_FEED_ROWS, RAW_FEED)


def normalize_feed(raw: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One typed row per employee: the one with the latest record date, as text.

    Equal record dates fall to ``tiebreak`` columns of ``raw``, by default to the
    remaining columns in turn.
    """
    others = ["birth_date", "date_of_joining", "first_name", "last_name"]
    extra = [c for c in tiebreak if c not in FEED.names]
    typed = raw.select(
        F.col("emp_id").cast("int").alias("emp_id"),
        "first_name",
        "last_name",
        parse_date("dob").alias("birth_date"),
        F.col("doj").alias("date_of_joining"),
        "record_date",
        *extra,
    )
    latest = latest_by(typed, ["emp_id"], "record_date", list(tiebreak) or others)
    return require_schema(latest.select(FEED.names), FEED)


def feed_columns(stored: DataFrame) -> DataFrame:
    """The six columns of a stored feed table, as the appended table takes them."""
    columns = [F.col(c).cast("int").alias(c) if c == "emp_id" else F.col(c) for c in FEED.names]
    return require_schema(stored.select(columns), FEED)
