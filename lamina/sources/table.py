"""Stored tables: immutable Parquet loads and a small snapshot file.

    <path>/load=1/part-*.parquet
    <path>/load=2/bucket=7/part-*.parquet       keyed tables only
    <path>/_snapshots/00000002.json             the loads that are live

Every write makes a new load; publishing it is one rename of the next snapshot
file. Readers see the old content or the new one. A job that dies leaves a load
that no snapshot names, and the rerun writes another.

A keyed table spreads its rows over ``buckets`` folders by a hash of the key, so
an upsert looks only into the folders its batch falls into. Rows with a null in
the key match nothing and lie in a folder of their own, which upserts never read; so
do the rows of a history that are closed. Within a bucket's files rows are sorted by
key, so that a few keys read a few pages. A snapshot names folders, and for each the
few files in it that have been replaced; a folder that would have more of them is
rewritten whole, so neither grows with the number of files.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.sources import files

LOAD = "load"
BUCKET = "bucket"
FILE = "_stored_file"
NULL_BUCKET = -1
CLOSED_BUCKET = -2
#: Replaced files that a snapshot names of one folder.
REPLACED_FILES = 8
#: Keys that are looked for by value; of more the least and greatest limit what is read.
PUSHED_KEYS = 64
#: Buckets of a new keyed table that asks for no number, and the bytes that a bucket may
#: have before a first write takes more of them.
BUCKETS = 16
BUCKET_BYTES = 1 << 30
COMPACT_BYTES = 64 << 20
#: Load numbers count in steps of this; the rest is random, so that two writers which
#: saw the same loads never write into one folder.
LOAD_STEP = 1_000_000


@dataclass(frozen=True)
class Snapshot:
    """What a table holds at one moment."""

    number: int
    schema: T.StructType
    parts: tuple[str, ...]
    key: tuple[str, ...] = ()
    buckets: int = 0
    marks: Mapping[str, int] = field(default_factory=dict)
    without: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    closed: str = ""

    def to_json(self) -> str:
        return json.dumps(
            {
                "number": self.number,
                "schema": self.schema.jsonValue(),
                "parts": self.parts,
                "key": self.key,
                "buckets": self.buckets,
                "marks": dict(self.marks),
                "without": dict(self.without),
                "closed": self.closed,
            }
        )

    @staticmethod
    def from_json(text: str) -> Snapshot:
        stored = json.loads(text)
        return Snapshot(
            number=stored["number"],
            schema=T.StructType.fromJson(stored["schema"]),
            parts=tuple(stored["parts"]),
            key=tuple(stored["key"]),
            buckets=stored["buckets"],
            marks=stored["marks"],
            without={part: tuple(names) for part, names in stored.get("without", {}).items()},
            closed=stored.get("closed", ""),
        )


class Layout(NamedTuple):
    key: tuple[str, ...]
    buckets: int
    closed: str = ""


class Table:
    """A stored table at ``path``.

    ``key`` and ``buckets`` count at the first write and stay as they were then;
    asking for another number of buckets later raises. Without a number the first write
    takes one bucket per gigabyte and at least 16; ``rebucket`` changes it later.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str | Sequence[str] = (),
        buckets: int | None = None,
        closed: str = "",
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self._key = tuple(filter(None, [key] if isinstance(key, str) else key))
        self._asked = buckets
        self._buckets = (BUCKETS if buckets is None else buckets) if self._key else 0
        self._closed = closed

    # -- state ---------------------------------------------------------------

    def snapshot(self) -> Snapshot | None:
        """The newest published state, or None before the first write."""
        published = [n for n in files.names(self.spark, self._log) if n.endswith(".json")]
        if not published:
            return None
        return Snapshot.from_json(files.read_text(self.spark, f"{self._log}/{published[-1]}"))

    def exists(self) -> bool:
        return self.snapshot() is not None

    @property
    def key(self) -> tuple[str, ...]:
        return self._layout().key

    def _layout(self) -> Layout:
        before = self.snapshot()
        if before is None:
            return Layout(self._key, self._buckets, self._closed)
        if self._asked is not None and before.buckets and before.buckets != self._asked:
            raise ValueError(f"the table at {self.path} has {before.buckets} buckets, not {self._asked}")
        return Layout(before.key, before.buckets, before.closed)

    # -- reading -------------------------------------------------------------

    def read(self, snapshot: Snapshot | None = None) -> DataFrame:
        """The rows of the newest snapshot, or of the one given."""
        snapshot = snapshot or self.snapshot()
        if snapshot is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.scan(snapshot.schema, snapshot.parts, snapshot.without).drop(LOAD, BUCKET)

    def read_open(self) -> DataFrame:
        """The rows that may still be updated; no file of closed ones is part of the plan."""
        state = self.snapshot()
        parts = [p for p in self.bucket_parts(state.parts) if bucket_number(p) != CLOSED_BUCKET]
        return self.scan(state.schema, parts, state.without).drop(LOAD, BUCKET)

    def scan(
        self, schema: T.StructType, parts: Iterable[str], without: Mapping[str, Sequence[str]] | None = None
    ) -> DataFrame:
        """The rows of some loads, buckets or files, with the folder columns, without replaced files."""
        folders = T.StructType([T.StructField(LOAD, T.LongType()), T.StructField(BUCKET, T.IntegerType())])
        full = T.StructType(schema.fields + folders.fields)
        parts = list(parts)
        if not parts:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", self.path).parquet(*[f"{self.path}/{p}" for p in parts])
        replaced = [f"{part}/{name}" for part in parts if part in (without or {}) for name in without[part]]
        if not replaced:
            return rows
        # The file index tests whole names before it plans to read a file, if it spells them so; the names below the
        # table are tested in any case.
        base, name = files.uri(self.spark, self.path), F.col("_metadata.file_path")
        below = F.substring_index(name, f"/{LOAD}=", -1)
        unnamed = ~below.isin([file.removeprefix(f"{LOAD}=") for file in replaced])
        return rows.where(~name.isin([f"{base}/{file}" for file in replaced])).where(unnamed)

    def rows_beside(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the given keys, each of them once.

        The key columns of the touched buckets are looked through, as far as their pages may
        hold one of the keys; other columns are read from the files that hold some.
        """
        state = self.snapshot()
        numbers = keys.select(bucket_of(state.key, state.buckets)).distinct().collect()
        touched = {row[0] for row in numbers} - {NULL_BUCKET}
        hit = [p for p in self.bucket_parts(state.parts) if bucket_number(p) in touched]
        if not hit:
            return self.scan(state.schema, []).drop(LOAD, BUCKET)
        wanted = among(keys)
        places = with_file(self.scan(state.schema, hit, state.without).where(wanted)).join(keys, keys.columns, "left_semi")
        _, _, holders = self.split(state, hit, self.held(places))
        rows = self.scan(state.schema, holders, state.without).where(wanted)
        return rows.drop(LOAD, BUCKET).join(keys, keys.columns, "left_semi")

    def held(self, rows: DataFrame) -> dict[str, list[str]]:
        """The folders that scanned ``rows`` lie in, with the names of their files, one more than may be replaced at most."""
        below = F.substring_index(FILE, f"/{LOAD}=", -1)
        folder = F.concat(F.lit(f"{LOAD}="), F.regexp_extract(below, "^(.*)/([^/]+)$", 1))
        found = rows.select(folder.alias("part"), F.substring_index(below, "/", -1).alias("name")).distinct()
        by_folder = found.groupBy("part").agg(F.slice(F.array_sort(F.collect_list("name")), 1, REPLACED_FILES + 1).alias("names"))
        return {r.part: r.names for r in by_folder.collect()}

    def split(
        self, before: Snapshot, parts: Iterable[str], held: Mapping[str, Sequence[str]]
    ) -> tuple[list[str], dict[str, tuple[str, ...]], list[str]]:
        """What stays of ``parts`` without the files ``held``, the files it stays without, and what is to be rewritten.

        A folder of few such files stays without them, another is rewritten whole.
        """
        stay, without, again = [], {}, []
        for part in parts:
            names = held.get(part, ())
            replaced = sorted({*before.without.get(part, ()), *names})
            if names and len(replaced) > REPLACED_FILES:
                again.append(part)
                continue
            stay.append(part)
            again += [f"{part}/{name}" for name in names]
            if replaced:
                without[part] = tuple(replaced)
        return stay, without, again

    # -- writing -------------------------------------------------------------

    def overwrite(self, df: DataFrame, publish: bool = True) -> Snapshot:
        """Replace the whole content."""
        before = self.snapshot()
        made = self.replaced(before, df.schema, self.write(df))
        return self.publish(made) if publish else made

    def replaced(self, before: Snapshot | None, schema: T.StructType, load: str) -> Snapshot:
        """The state after ``before`` in which one written load is the whole table."""
        layout = self._layout()
        return Snapshot(
            number=before.number + 1 if before else 1,
            schema=schema,
            parts=(load,),
            key=layout.key,
            buckets=layout.buckets,
            marks=before.marks if before else {},
            closed=layout.closed,
        )

    def append(self, df: DataFrame, publish: bool = True, marks: Mapping[str, int] | None = None) -> Snapshot:
        """Add rows without a look at those present."""
        before = self.snapshot()
        if before is None:
            raise FileNotFoundError(f"no table at {self.path}")
        load = self.write(self.fit(df, before.schema))
        made = self.next(before, before.parts + (load,), marks)
        return self.publish(made) if publish else made

    def next(
        self,
        before: Snapshot,
        parts: Iterable[str],
        marks: Mapping[str, int] | None = None,
        without: Mapping[str, tuple[str, ...]] | None = None,
    ) -> Snapshot:
        """The state after ``before`` that consists of ``parts``, some of them ``without`` further files."""
        parts = tuple(parts)
        replaced = {**before.without, **(without or {})}
        return replace(
            before,
            number=before.number + 1,
            parts=parts,
            marks={**before.marks, **(marks or {})},
            without={part: replaced[part] for part in parts if part in replaced},
        )

    def marked(self, snapshot: Snapshot, marks: Mapping[str, int]) -> Snapshot:
        """The same state with the last micro-batch numbers of streams."""
        return replace(snapshot, marks={**snapshot.marks, **marks})

    def publish(self, snapshot: Snapshot) -> Snapshot:
        """Make a written state the current one; fails if another run came first."""
        files.write_once(self.spark, f"{self._log}/{snapshot.number:08d}.json", snapshot.to_json())
        return snapshot

    def write(self, df: DataFrame, gather: bool = True) -> str:
        """Store ``df`` as a new load that no snapshot names yet.

        ``gather`` brings the rows of one bucket together first: the runtime splits
        a bucket that is too large for one task and joins those that are small.

        The first write of a keyed table without a number of buckets is measured; if its
        buckets came out too large, the stored rows are spread again over enough of them.
        """
        layout = self._layout()
        load = self._store(df, layout, gather)
        if layout.key and self._asked is None and self.snapshot() is None:
            enough = -(-files.size(self.spark, f"{self.path}/{load}") // BUCKET_BYTES)
            if enough > layout.buckets:
                self._buckets = enough
                spread = self._store(self.scan(df.schema, [load]).drop(LOAD, BUCKET), self._layout(), True)
                files.delete(self.spark, f"{self.path}/{load}")
                return spread
        return load

    def rebucket(self, buckets: int | None = None) -> Snapshot:
        """Spread a keyed table over another number of buckets; by default one per gigabyte.

        This rewrites the whole table, for one that has outgrown its first number. It
        publishes a state like any writer and fails if another came first.
        """
        before = self.snapshot()
        if before is None or not before.key:
            raise ValueError(f"no keyed table at {self.path}")
        if buckets is None:
            stored = sum(files.size(self.spark, f"{self.path}/{part}") for part in before.parts)
            buckets = max(BUCKETS, -(-stored // BUCKET_BYTES))
        load = self._store(self.read(before), Layout(before.key, buckets, before.closed), True)
        made = self.publish(replace(self.next(before, [load]), buckets=buckets))
        self._asked = self._asked and buckets
        return made

    def _store(self, df: DataFrame, layout: Layout, gather: bool) -> str:
        taken = {LOAD, BUCKET} & {c.lower() for c in df.columns}
        if taken:
            raise ValueError(f"column names {sorted(taken)} are used by the folders")
        part = f"{LOAD}={self._next_load()}"
        if not layout.key:
            df.write.parquet(f"{self.path}/{part}")
            return part
        placed = df.withColumn(BUCKET, bucket_of(layout.key, layout.buckets, layout.closed))
        if gather:
            placed = placed.hint("rebalance", BUCKET)
        placed.sortWithinPartitions(BUCKET, *layout.key).write.partitionBy(BUCKET).parquet(f"{self.path}/{part}")
        return part

    def bucket_parts(self, parts: Iterable[str]) -> list[str]:
        """``parts`` with every whole load replaced by the buckets it holds."""
        out = []
        for part in parts:
            if f"/{BUCKET}=" in part:
                out.append(part)
            else:
                inside = files.names(self.spark, f"{self.path}/{part}")
                out.extend(f"{part}/{name}" for name in inside if name.startswith(f"{BUCKET}="))
        return out

    def fit(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """``df`` with the stored columns, in the stored order and types."""
        extra = {c.lower() for c in df.columns} ^ {f.name.lower() for f in schema}
        if extra:
            raise ValueError(f"columns differ from the stored table: {sorted(extra)}")
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def compact(self, below: int = COMPACT_BYTES) -> Snapshot | None:
        """Rewrite the loads of fewer bytes than ``below`` as one; the rows stay the same.

        Appends and micro-batches leave a load each. Readers and the snapshot file then
        carry a few large loads instead. Run it between writes: it publishes a state
        like any writer and fails if another came first.
        """
        before = self.snapshot()
        if before is None:
            return None
        small = [p for p in before.parts if files.size(self.spark, f"{self.path}/{p}") < below]
        if len(small) < 2:
            return before
        load = self.write(self.scan(before.schema, small, before.without).drop(LOAD, BUCKET))
        kept = set(small)
        return self.publish(self.next(before, [p for p in before.parts if p not in kept] + [load]))

    def expire(self, keep: int = 2) -> None:
        """Delete the snapshots before the last ``keep`` and the loads only they name.

        Loads newer than the last snapshot may belong to a running write and stay.
        """
        numbers = [n for n in files.names(self.spark, self._log) if n.endswith(".json")]
        if keep < 1 or not numbers:
            return
        kept = [Snapshot.from_json(files.read_text(self.spark, f"{self._log}/{n}")) for n in numbers[-keep:]]
        live = {part.split("/")[0] for snapshot in kept for part in snapshot.parts}
        newest = max((_load_number(part) for part in live), default=0)
        for name in numbers[:-keep]:
            files.delete(self.spark, f"{self._log}/{name}")
        for name in files.names(self.spark, self.path):
            if name.startswith(f"{LOAD}=") and name not in live and _load_number(name) // LOAD_STEP < newest // LOAD_STEP:
                files.delete(self.spark, f"{self.path}/{name}")

    # -- names ---------------------------------------------------------------

    @property
    def _log(self) -> str:
        return f"{self.path}/_snapshots"

    def _next_load(self) -> int:
        loads = [_load_number(n) for n in files.names(self.spark, self.path) if n.startswith(f"{LOAD}=")]
        return (max(loads, default=0) // LOAD_STEP + 1) * LOAD_STEP + random.randrange(LOAD_STEP)


def bucket_of(key: Sequence[str], buckets: int, closed: str = "") -> Column:
    """The folder of a row: a hash of its key, or the folder of null keys or of closed rows."""
    whole = reduce(Column.__and__, [F.col(name).isNotNull() for name in key])
    spread = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    placed = F.when(whole, spread).otherwise(F.lit(NULL_BUCKET))
    return F.when(F.col(closed).isNotNull(), F.lit(CLOSED_BUCKET)).otherwise(placed) if closed else placed


def among(keys: DataFrame) -> Column:
    """A filter that Parquet tests by its statistics and passes every row of the given keys.

    Few keys are named one by one, of others the least and the greatest value of the first column.
    """
    some = keys.limit(PUSHED_KEYS + 1).collect()
    if not some:
        return F.lit(False)
    if any(isinstance(value, (dict, list, tuple)) for value in some[0]):
        return F.lit(True)
    if len(some) <= PUSHED_KEYS:
        each = [reduce(Column.__and__, [F.col(c) == F.lit(v) for c, v in row.asDict().items()]) for row in set(some)]
        return reduce(Column.__or__, each)
    first = F.col(keys.columns[0])
    low, high = keys.agg(F.min(first), F.max(first)).first()
    return first.between(F.lit(low), F.lit(high))


def bucket_number(part: str) -> int:
    return int(part.rsplit(f"{BUCKET}=", 1)[1].split("/")[0])


def with_file(rows: DataFrame) -> DataFrame:
    """Scanned rows with the file that each lies in."""
    return rows.withColumn(FILE, rows.metadataColumn("_metadata").getField("file_path"))


def _load_number(part: str) -> int:
    return int(part.split("/")[0].split("=", 1)[1])
