"""The three ways to bring a stored table up to date."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.sources import files
from lamina.sources.table import BUCKET, LOAD, Snapshot, Table, among, bucket_number, with_file


# Keys that every executor may hold, by number and by the bytes of their values in memory,
# and the size that files should have. They choose the plan, never the result.
BROADCAST_KEYS = 1_000_000
BROADCAST_BYTES = 32 << 20
FILE_BYTES = 64 << 20


class DuplicateKeys(ValueError):
    """A merge batch names one key more than once."""


class Size(NamedTuple):
    """Of a set of keys: how many, and the bytes of their values, not as compressed on disk."""

    rows: int
    bytes: int

    def fits_everywhere(self) -> bool:
        return self.rows <= BROADCAST_KEYS and self.bytes <= BROADCAST_BYTES


def append_incremental(
    df: DataFrame,
    target: Table,
    column: str,
    value: str,
    idempotent: bool = False,
    publish: bool = True,
) -> Snapshot:
    """All rows on the first run; afterwards the rows where ``column`` is ``value``.

    Nothing is compared with the target, so running the same value twice adds
    its rows twice. ``idempotent=True`` first takes the target's rows of that
    value away, rewriting only the files that hold some.
    """
    if not target.exists():
        return target.overwrite(df, publish)
    batch = df.where(F.col(column) == F.lit(value))
    if not idempotent:
        return target.append(batch, publish)
    before = target.snapshot()
    parts = target.bucket_parts(before.parts) if before.key else before.parts
    # The filter is tested against row-group statistics; the names of files return.
    stored = with_file(target.scan(before.schema, parts, before.without).where(F.col(column) == F.lit(value)))
    stay, without, again = target.split(before, parts, target.held(stored))
    if again:
        others = target.scan(before.schema, again, before.without).drop(LOAD, BUCKET)
        stay.append(target.write(others.where(~F.col(column).eqNullSafe(F.lit(value)))))
    stay.append(target.write(target.fit(batch, before.schema)))
    made = target.next(before, stay, without=without)
    return target.publish(made) if publish else made


def delete_insert(
    batch: DataFrame,
    target: Table,
    publish: bool = True,
    marks: Mapping[str, int] | None = None,
) -> Snapshot:
    """Drop the target rows whose key is in the batch, then add the whole batch.

    Duplicate keys in the batch are all added. Null keys match nothing.
    """
    return _replace_keys(batch, target, publish, marks, unique=False)


def merge_upsert(
    batch: DataFrame,
    target: Table,
    publish: bool = True,
    marks: Mapping[str, int] | None = None,
) -> Snapshot:
    """Update every column of the target rows whose key is in the batch, add the rest.

    A key twice in the batch raises ``DuplicateKeys`` and changes nothing. Null
    keys match nothing, so they are added on every run.
    """
    return _replace_keys(batch, target, publish, marks, unique=True)


def _replace_keys(
    batch: DataFrame,
    target: Table,
    publish: bool,
    marks: Mapping[str, int] | None,
    unique: bool,
) -> Snapshot:
    key = list(target.key)
    if not key:
        raise ValueError(f"the table at {target.path} has no key")
    before = target.snapshot()
    schema = before.schema if before else batch.schema

    # The batch is computed once. Its stored rows are already part of the result.
    staged = target.write(target.fit(batch, schema))
    matchable = [p for p in target.bucket_parts([staged]) if bucket_number(p) >= 0]
    batch_rows = target.scan(schema, matchable)

    # Keys lie below the table, on storage that all executors share, until the write is done.
    scratch = f"{target.path}/_scratch/{uuid.uuid4().hex}"
    try:
        if matchable and (unique or before):
            keys = _stored_keys(batch_rows, key, f"{scratch}/batch")
            size = _measured(keys, unique)
        if before is None:
            made = target.marked(target.replaced(before, schema, staged), marks or {})
        else:
            touched = {bucket_number(p) for p in matchable}
            parts = target.bucket_parts(before.parts)
            hit = [p for p in parts if bucket_number(p) in touched]
            result = [p for p in parts if bucket_number(p) not in touched]
            without: dict[str, tuple[str, ...]] = {}
            if hit:
                rewritten, without = _rewritten(target, before, hit, keys.select(*key), size, len(touched), scratch)
                result += rewritten
            made = target.next(before, [*result, staged], marks, without)
    finally:
        files.delete(target.spark, scratch)
    return target.publish(made) if publish else made


def _stored_keys(rows: DataFrame, key: list[str], path: str) -> DataFrame:
    """Each key of the batch once, with its count, as a written table."""
    rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows")).write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _measured(keys: DataFrame, unique: bool = False) -> Size:
    names = [c for c in keys.columns if c != "_rows"]
    # A broadcast row also has a header, offsets and its place in the hash table.
    width = sum((F.octet_length(F.col(c).cast("string")) for c in names), F.lit(32 + 8 * len(names)))
    most = F.max("_rows") if unique else F.lit(1)
    found, width_sum, most_rows = keys.agg(F.count(F.lit(1)), F.sum(width.cast("long")), most).first()
    if most_rows and most_rows > 1:
        example = keys.where("_rows > 1").drop("_rows").first()
        raise DuplicateKeys(f"more than one batch row for {example.asDict()}")
    return Size(found, width_sum or 0)


def _rewritten(
    target: Table, before: Snapshot, hit: list[str], keys: DataFrame, size: Size, touched: int, scratch: str
) -> tuple[list[str], dict[str, tuple[str, ...]]]:
    """The parts that replace the touched buckets ``hit``, without the rows of ``keys``, and the files they are without.

    If the keys can be broadcast, a scan of the key columns' pages that may hold some finds the
    files that do; only those are rewritten, or their whole folder if they are many of it, and the
    others keep their place. Where the buckets have too many files for their bytes, or one file
    each, they are rewritten whole.
    """
    schema = before.schema
    old = target.scan(schema, hit, before.without)
    count, crowded = _files(old), _too_many_files(old, touched)
    stay: list[str] = []
    without: dict[str, tuple[str, ...]] = {}
    if size.fits_everywhere() and not crowded and count > touched:
        places = with_file(old.where(among(keys))).join(F.broadcast(keys), keys.columns, "left_semi")
        stay, without, again = target.split(before, hit, target.held(places))
        if not again:
            return stay, without
        old = target.scan(schema, again, before.without)
    kept, gather = _without_keys(old, keys, size, crowded, f"{scratch}/kept")
    return [*stay, target.write(target.fit(kept, schema), gather)], without


def _without_keys(
    old: DataFrame, keys: DataFrame, size: Size, crowded: bool, scratch: str
) -> tuple[DataFrame, bool]:
    """The old rows that stay, and whether to gather them by bucket for the write.

    With few batch keys, or few old keys that stay, those are broadcast, and the
    rows go from scan to write in one stage, file by file; they are gathered only
    when the files have become too many for their bytes. Otherwise rows and keys
    are sorted and merged, where the runtime splits a key that fills the table;
    that spreads the rows by key, so they have to be gathered.
    """
    key = keys.columns
    rows = old.drop(LOAD, BUCKET)
    if size.fits_everywhere():
        return rows.join(F.broadcast(keys), key, "left_anti"), crowded
    # A batch that may cover nearly the whole table: compare the key columns first.
    if old.count() - size.rows <= BROADCAST_KEYS:
        rows.select(*key).distinct().join(keys, key, "left_anti").write.parquet(scratch)
        staying = old.sparkSession.read.parquet(scratch)
        if _measured(staying).fits_everywhere():
            return rows.join(F.broadcast(staying), key, "left_semi"), crowded
    return rows.join(keys, key, "left_anti"), True


def _files(old: DataFrame) -> int:
    # The list of files stays in the JVM, only its length is asked for.
    return len(old._jdf.inputFiles())


def _too_many_files(old: DataFrame, buckets: int) -> bool:
    return _files(old) > 2 * max(buckets, _stored_bytes(old) // FILE_BYTES)


def _stored_bytes(df: DataFrame) -> int:
    return int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
