"""Near duplicates by SimHash and an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of
their eight bytes, so they share at least five bytes at equal positions: the guaranteed
minimum. An index of single positional bytes would put one 256th of all fingerprints
into each posting, so its entries are the 70 choices of four positions with their bytes:
pairs that share four bytes meet. The positional bytes that a pair shares are tallied;
pairs below the minimum are dropped by this count, and the bits of the others verified.

No task holds an unbounded posting. What meets in one of more than HELD fingerprints is
passed on unread and indexed again under the 56 choices of five positions: pairs with the
minimum meet there too, and such a posting has distinct fingerprints that agree in 40 of 64
bits, 2^24 at most, whatever the number of documents. A posting emits a spanning star per linked
group, not all its pairs; large postings look up the neighbours of a fingerprint within three
bits instead of comparing it with every other one.

Edge cases: a null text has no words; texts without words have fingerprint zero and are
linked like any others; a repeated doc_id is one node per text; null doc_ids are never
the smallest id of a group unless all its ids are null, which gives null. Where one row of
each group is kept, rows are told apart by all of their columns, not by the id; of rows that
are equal in every column any one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.components import components
from lamina.llm.tables import settle

SEED = 42
SHINGLE = 3
MAX_BITS = 3
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
#: Positions whose bytes an entry of the index holds: one fewer than the minimum, and the minimum where many meet.
COARSE = list(combinations(range(BYTES), MIN_SHARED - 1))
FINE = list(combinations(range(BYTES), MIN_SHARED))
#: Fingerprints of one coarse posting that a task holds at most.
HELD = 1 << 22
#: Tasks that equal rows are dealt out to.
SALTS = 32
#: Shingles hashed at once, so that a very long text needs little memory.
BLOCK = 65_536
#: Above so many fingerprints that are still to be placed, neighbours are looked up.
LOOK_UP = 40_000


def simhash(text: str) -> int:
    """The fingerprint, as a signed 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:]))
    total, ones = max(1, len(words) - SHINGLE + 1), np.zeros(64, np.int64)
    digest, block = xxhash.xxh64_digest, []
    for gram in grams:
        block.append(digest(gram, SEED))
        if len(block) == BLOCK:
            ones += _ones(block)
            block = []
    if block:
        ones += _ones(block)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def _ones(digests: list[bytes]) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduce(bits, axis=0, dtype=np.uint32).astype(np.int64)


@F.pandas_udf(T.LongType())
def simhash_of(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(text) for text in texts], dtype=np.int64)


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, bits``: one row per document."""
    return documents.select("doc_id", simhash_of(F.coalesce("text", F.lit(""))).alias("bits"))


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * (BYTES - 1 - p) for p in positions)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def index(bits: DataFrame, positions: list[tuple[int, ...]] = COARSE) -> DataFrame:
    """``posting, entry, bits``: each fingerprint under each choice of positional bytes."""
    entries = F.array(*[F.col("bits").bitwiseAND(F.lit(_mask(p)).cast("long")) for p in positions])
    return bits.select(F.posexplode(entries).alias("posting", "entry"), "bits")


def links(bits: DataFrame, held: int = HELD) -> DataFrame:
    """``a, b``: enough edges to connect all fingerprints that differ in three bits at most.

    ``bits`` holds each fingerprint once; an edge may come twice.
    """
    met = settle(_met(bits, COARSE, held).distinct(), "simhash-met", bits.count())
    crowded = met.where("b is null").select(F.col("a").alias("bits"))
    return met.where("b is not null").unionByName(_met(crowded, FINE, None))


def _met(bits: DataFrame, positions: list[tuple[int, ...]], held: int | None) -> DataFrame:
    """``a, b``: edges of the postings; a fingerprint and null from those of more than ``held`` fingerprints."""
    entries = index(bits, positions).repartition("posting", "entry").sortWithinPartitions("posting", "entry", "bits")
    return entries.mapInArrow(lambda batches: _links_of_postings(batches, positions, held), "a long, b long")


class _Posting:
    """The posting that may go on in the next batch; its parts are joined once, when it ends."""

    def __init__(self, key: tuple[int, int], positions: list[tuple[int, ...]], held: int | None) -> None:
        self.key, self.positions, self.held = key, positions[key[0]], held
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(bits)
        self.size += len(bits)
        if self.held is not None and self.size > self.held:
            for part in self.parts:
                yield _batch(pa.array(part), pa.nulls(len(part), pa.int64()))
            self.parts = []

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield _edge_batch([stars(np.concatenate(self.parts).view(np.uint64), self.positions)])


def _links_of_postings(
    batches: Iterator[pa.RecordBatch], positions: list[tuple[int, ...]], held: int | None
) -> Iterator[pa.RecordBatch]:
    """Postings arrive sorted; the last one of a batch may go on in the next."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        posting, entry, bits = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        starts = _starts(posting, entry)
        begin = 0
        if last is not None:
            if last.key == (posting[0], entry[0]):
                begin = starts[1] if len(starts) > 1 else len(bits)
                yield from last.add(bits[:begin])
            if begin == len(bits):
                continue
            yield from last.close()
        end = starts[-1]
        if end > begin:
            yield _edges(posting[begin:end], entry[begin:end], bits[begin:end].view(np.uint64), positions)
        last = _Posting((posting[end], entry[end]), positions, held)
        yield from last.add(bits[end:])
    if last is not None:
        yield from last.close()


def _starts(posting: np.ndarray, entry: np.ndarray) -> np.ndarray:
    new = (posting[1:] != posting[:-1]) | (entry[1:] != entry[:-1])
    return np.concatenate([[0], 1 + np.flatnonzero(new)])


def _edges(
    posting: np.ndarray, entry: np.ndarray, bits: np.ndarray, positions: list[tuple[int, ...]]
) -> pa.RecordBatch:
    """Edges of whole postings that lie within one batch."""
    starts = _starts(posting, entry)
    sizes = np.diff([*starts, len(bits)])
    # Postings of two, by far the most, all at once.
    first = starts[sizes == 2]
    near = _linked(bits[first], bits[first + 1])
    found = [(bits[first[near]], bits[first[near] + 1])]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        found.append(stars(bits[start : start + size], positions[posting[start]]))
    return _edge_batch(found)


def _edge_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return _batch(*(pa.array(np.concatenate(side).view(np.int64)) for side in zip(*found)))


def _batch(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def tally(differ: np.ndarray) -> np.ndarray:
    """How many positional bytes a pair shares, from the bits in which it differs."""
    shared = np.zeros(differ.shape, np.int8)
    for p in range(BYTES):
        shared += (differ & np.uint64(0xFF << 8 * p)) == 0
    return shared


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs that share the guaranteed minimum of positional bytes, then verified by their bits."""
    differ = x ^ y
    near = tally(differ) >= MIN_SHARED
    near[near] = np.bitwise_count(differ[near]) <= MAX_BITS
    return near


def stars(bits: np.ndarray, positions: tuple[int, ...], look_up: int = LOOK_UP) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each member of a posting to the first of its linked group, by breadth-first search."""
    masks = None
    rest = np.sort(bits)
    hubs, members = [], []
    while len(rest) > 1:
        hub, rest = rest[0], rest[1:]
        frontier = np.array([hub], np.uint64)
        while len(frontier) and len(rest):
            if len(rest) > look_up:
                masks = _neighbours(positions) if masks is None else masks
                near = _found_near(frontier, rest, masks)
            else:
                near = np.zeros(len(rest), bool)
                step = max(1, 1_000_000 // len(rest))
                for i in range(0, len(frontier), step):
                    near |= _linked(frontier[i : i + step, None], rest[None, :]).any(0)
            frontier, rest = rest[near], rest[~near]
            hubs.append(np.full(len(frontier), hub))
            members.append(frontier)
    nothing = np.zeros(0, np.uint64)
    return np.concatenate([nothing, *hubs]), np.concatenate([nothing, *members])


def _neighbours(positions: tuple[int, ...]) -> np.ndarray:
    """All ways to flip up to three bits outside the shared bytes."""
    free = [8 * (BYTES - 1 - p) + i for p in range(BYTES) if p not in positions for i in range(8)]
    flips = [sum(1 << i for i in c) for n in range(1, MAX_BITS + 1) for c in combinations(free, n)]
    return np.array(flips, np.uint64)


def _found_near(frontier: np.ndarray, rest: np.ndarray, masks: np.ndarray) -> np.ndarray:
    near = np.zeros(len(rest), bool)
    for i in range(0, len(frontier), 512):
        wanted = (frontier[i : i + 512, None] ^ masks[None, :]).ravel()
        at = np.minimum(np.searchsorted(rest, wanted), len(rest) - 1)
        near[at[rest[at] == wanted]] = True
    return near


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, bits, component_id``: one row per document with the smallest doc_id that links reach."""
    marked = settle(fingerprints(documents), "simhash")
    nodes = settle(marked.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-nodes", marked.count())
    rooted = _rooted(nodes)
    least = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(classes, "bits").select("doc_id", "bits", "component_id")


def _rooted(nodes: DataFrame) -> DataFrame:
    """``bits, least, root`` of ``bits, least``: the smallest fingerprint that links reach."""
    linked = settle(components(links(nodes.select("bits"))), "simhash-linked", nodes.count())
    return nodes.join(linked.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "least", F.coalesce("root", "bits").alias("root")
    )


def shown(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def _row_key(documents: DataFrame) -> Column:
    """A hash of the row's columns, the same on every read; only equal rows share it."""
    others = [c for c in documents.columns if c != "text"]
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in others])
    parts = [nulls, F.xxhash64(*[F.col(f"`{c}`") for c in others]).cast("string"), F.col("doc_id").cast("string")]
    return F.unhex(F.sha2(F.concat_ws(":", *parts, F.sha2("text", 256)), 256))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One row of each group: that with the smallest id, and of several with this id the first by a hash of the row.

    A row without an id stays only if its group has no row with one. Whole rows are shuffled once,
    by their hash, at any size of the input: a plan that broadcasts the hashes of the rows that
    go while they are few would cost ever more per row as the input grows. Rows that are equal
    in every column take a second pass, if there are any.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    keyed = documents.select(row.alias("document"), "doc_id", "text", _row_key(documents).alias("key"))
    marked = settle(keyed.select("doc_id", "key", simhash_of(F.coalesce("text", F.lit(""))).alias("bits")), "simhash")
    most = marked.count()
    rows = settle(marked.groupBy("bits", "doc_id", "key").agg(F.count("*").alias("n")), "simhash-rows", most)
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "n")
    nodes = settle(rows.groupBy("bits").agg(F.min(order).alias("least")), "simhash-nodes", most)
    least = _rooted(nodes).groupBy("root").agg(F.min("least").alias("least"))
    firsts = settle(least.select("least.key", "least.n"), "simhash-firsts", most)
    others = rows.select("key").join(firsts.where("n = 1"), "key", "left_anti")
    others = settle(others, "simhash-others", most)
    kept = keyed.select("document", "key").join(others.hint("shuffle_hash"), "key", "left_anti").select("document.*")
    again = firsts.where("n > 1").select("key")
    if again.isEmpty():
        return kept
    # Equal rows may be a third of the table: they are dealt out by a salt as well, and combined before they meet.
    salted = keyed.select("document", "key", (F.spark_partition_id() % SALTS).alias("salt"))
    each = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    repeated = salted.join(each, ["key", "salt"], "left_semi").groupBy("key").agg(F.first("document").alias("document"))
    return kept.unionByName(repeated.select("document.*"))
