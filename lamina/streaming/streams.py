"""Files that arrive over time, into the same stored tables as the batch jobs.

Each micro-batch carries its number into the table's snapshot. A batch that is
replayed after a lost driver finds its number there and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lamina.operators.conform import conform
from lamina.operators.incremental import merge_upsert
from lamina.operators.latest import latest_by
from lamina.sources.table import Snapshot, Table


class Once(NamedTuple):
    """What makes a record one that has landed before.

    ``columns`` tell records apart, by default all declared ones. A record is remembered until the
    column ``time`` of what has arrived is ``delay`` beyond it; the state store holds no more.
    ``time`` may be a column of the stream that is not declared, such as a file's time.
    """

    time: str
    delay: str
    columns: Sequence[str] = ()


def land_stream(
    stream: DataFrame,
    target: Table,
    schema: T.StructType,
    checkpoint: str,
    once: Once | None = None,
    compact_every: int = 0,
) -> StreamingQuery:
    """Append what has arrived, cast to the declared columns.

    With ``once``, records that come again, in whatever file, are left out. Every
    ``compact_every`` micro-batches the small loads become one and the states before the
    last two go, so that neither grows with the number of micro-batches.
    """
    declared = [f.name for f in schema]

    def store(batch: DataFrame, mark: dict[str, int]) -> Snapshot:
        rows = conform(batch, schema) if once is None else batch.select(*declared)
        if target.exists():
            made = target.append(rows, marks=mark)
        else:
            first = target.overwrite(rows, publish=False)
            made = target.publish(target.marked(first, mark))
        if compact_every and (mark[checkpoint] + 1) % compact_every == 0:
            made = target.compact()
            target.expire()
        return made

    if once is not None:
        # The state needs the declared types; the time may come from outside of them.
        carried = conform(stream, schema, keep=[once.time] if once.time not in declared else [])
        stream = carried.withWatermark(once.time, once.delay).dropDuplicatesWithinWatermark(list(once.columns) or declared)
    return _start(stream, target, checkpoint, store)


def merge_stream(
    stream: DataFrame,
    target: Table,
    order: str,
    tiebreak: Sequence[str],
    checkpoint: str,
) -> StreamingQuery:
    """Merge change records: of all records of a key that have arrived, the latest counts.

    It does not matter which micro-batch brings a record: a batch's latest records are
    compared with the stored rows of their keys, by ``order`` (null wins), then by
    ``tiebreak``, then by the other columns, and the winners are merged. What is read of
    the table follows the batch: pages of key columns that may hold one of its keys, and
    the files that do.

    A record of a deletion is a row like any other, with a flag that the stream's
    source sets; it stays stored, so that an older record which comes later does not
    bring its key back. ``without_deleted`` leaves such rows out.
    """

    def store(batch: DataFrame, mark: dict[str, int]) -> Snapshot:
        latest = latest_by(batch, target.key, order, tiebreak).persist()
        try:
            merged = latest
            if target.exists():
                same = target.rows_beside(latest.select(*target.key))
                merged = latest_by(target.fit(latest, same.schema).unionAll(same), target.key, order, tiebreak)
            return merge_upsert(merged, target, marks=mark)
        finally:
            latest.unpersist()

    return _start(stream, target, checkpoint, store)


def without_deleted(rows: DataFrame, deleted: str) -> DataFrame:
    """The rows that are not records of a deletion, without the flag; a null flag deletes nothing."""
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def _start(
    stream: DataFrame,
    target: Table,
    checkpoint: str,
    store: Callable[[DataFrame, dict[str, int]], Snapshot],
) -> StreamingQuery:
    def each(batch: DataFrame, number: int) -> None:
        state = target.snapshot()
        if state and state.marks.get(checkpoint, -1) >= number:
            return
        store(batch, {checkpoint: number})

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
