"""Type-2 history: what changed since the open rows were written."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.dates import run_timestamp
from lamina.operators.incremental import merge_upsert
from lamina.sources.table import Snapshot, Table


def first_history(source: DataFrame, run_ts: datetime | str) -> DataFrame:
    """Every source row as an open row."""
    return source.withColumns(
        {"valid_from": run_timestamp(run_ts), "valid_to": F.lit(None).cast("timestamp")}
    )


def history_changes(
    history: DataFrame, source: DataFrame, keys: Sequence[str], run_ts: datetime | str
) -> DataFrame:
    """Rows to merge on ``keys`` into the open rows ``history``: closed old versions, new versions.

    Values are compared, nulls included. Keys the source no longer has stay open.
    A source key that is null opens a row on every run. A row that was opened at
    this same run time is replaced, so a run can be repeated with corrected values.
    """
    columns = list(source.columns)
    at = run_timestamp(run_ts)
    old = history.where(F.col("valid_to").isNull()).select(
        F.struct(*[F.col(c) for c in keys]).alias("k"),
        F.struct(*columns).alias("old"),
        "valid_from",
    )
    new = source.select(F.struct(*[F.col(c) for c in keys]).alias("k"), F.struct(*columns).alias("new"))
    matched = [F.col(f"n.k.{c}") == F.col(f"o.k.{c}") for c in keys]
    pairs = (
        new.alias("n")
        .join(old.alias("o"), matched, "left")
        .where(~F.col("n.new").eqNullSafe(F.col("o.old")))
    )
    opened = F.struct(
        *[F.col(f"n.new.{c}").alias(c) for c in columns],
        at.alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
    )
    closed = F.struct(
        *[F.col(f"o.old.{c}").alias(c) for c in columns],
        F.col("o.valid_from").alias("valid_from"),
        at.alias("valid_to"),
    )
    rows = F.array(opened, F.when(F.col("o.valid_from") != at, closed))
    return pairs.select(F.inline(rows)).where(F.col("valid_from").isNotNull())


def record_history(source: DataFrame, target: Table, keys: Sequence[str], run_ts: datetime | str) -> Snapshot:
    """Bring a stored history up to date; ``target`` is keyed by ``keys`` and closed by ``valid_to``.

    Open rows lie apart from closed ones. A new version takes its key's open row away, and the
    old version is stored again as a closed row, so only open rows are ever read or rewritten.
    """
    if not target.exists():
        return merge_upsert(first_history(source, run_ts), target)
    return merge_upsert(history_changes(target.read_open(), source, keys, run_ts), target)


def history_table(spark: SparkSession, path: str, keys: Sequence[str], buckets: int | None = None) -> Table:
    """A stored history of rows with these keys."""
    return Table(spark, path, key=keys, buckets=buckets, closed="valid_to")
