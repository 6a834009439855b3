"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts form a group that is never divided. A partial partition is a
vector of shard sizes; a group alone is one with a single shard filled. Differencing
takes the two partial partitions with the largest spread and joins them oppositely
ordered, largest on smallest, until one is left.

A whole corpus does not pass through one task: groups fall into buckets by hash, each
bucket is differenced by itself, and what it leaves is again one partial partition, so
the buckets' vectors are differenced in the same way, a bounded number at a time, level
by level. Each level hands down where its shards went.

Edge cases: a null text counts as the empty one, in size and in grouping; equal sizes go
by group key; one shard, no rows, and a group larger than a shard's fair part are valid.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.tables import settle

SHARDS = 8
#: Partial partitions that one task differences.
BUCKET = 4096
#: Rows of a shard that one task numbers.
NUMBERED = 4096


def difference(vectors: np.ndarray) -> np.ndarray:
    """Where each vector's entries go: row i, column j is the final shard of vector i's entry j."""
    n, k = vectors.shape
    order = np.argsort(vectors, axis=1, kind="stable")  # ascending
    sums = np.take_along_axis(vectors, order, axis=1).tolist()
    # A node keeps its sums ascending; came says which entry of its parts each one holds.
    parts: list[tuple | None] = [None] * n
    heap = [(s[0] - s[-1], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        joined = [(a + b, i) for i, (a, b) in enumerate(zip(sums[x], reversed(sums[y])))]
        joined.sort()
        sums[x] = sums[y] = None
        sums.append([total for total, _ in joined])
        parts.append((x, y, [i for _, i in joined]))
        heapq.heappush(heap, (sums[-1][0] - sums[-1][-1], len(sums) - 1))
    shard: list = [None] * len(sums)
    if n:
        shard[-1] = list(range(k))
    for node in range(len(sums) - 1, n - 1, -1):
        x, y, came = parts[node]
        to_x = [0] * k
        for place, i in enumerate(came):
            to_x[i] = shard[node][place]
        shard[x], shard[y] = to_x, to_x[::-1]
        shard[node] = None
    out = np.empty((n, k), np.int32)
    np.put_along_axis(out, order, np.array(shard[:n], np.int32).reshape(n, k), axis=1)
    return out


def _groups_in(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "member"], ascending=[False, True])
        vectors = np.zeros((len(rows), shards), np.int64)
        vectors[:, 0] = rows["bytes"]
        return rows[["bucket", "member"]].assign(part=difference(vectors)[:, 0])

    return place


def _parts_in(shards: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        vectors = np.array(rows["sums"].tolist(), np.int64).reshape(len(rows), shards)
        moved = difference(vectors)
        return pd.DataFrame(
            {
                "bucket": np.repeat(rows["bucket"].to_numpy(), shards),
                "part": np.tile(np.arange(shards, dtype=np.int32), len(rows)),
                "onward": moved.ravel(),
            }
        )

    return place


def assign(groups: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """``member, shard`` for groups ``member`` (long, once each) and ``bytes`` (long)."""
    n_buckets = max(1, math.ceil(groups.count() / bucket))
    spread = groups.select(
        F.pmod(F.xxhash64("member"), F.lit(n_buckets)).alias("bucket"), "member", F.col("bytes").cast("long")
    )
    placed = settle(
        spread.groupBy("bucket").applyInPandas(_groups_in(shards), "bucket long, member long, part int"),
        "shard-parts",
    )
    sums = placed.join(groups, "member").groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    vector = [F.sum(F.when(F.col("part") == j, F.col("bytes")).otherwise(0)) for j in range(shards)]
    parts = sums.groupBy("bucket").agg(F.array(*vector).alias("sums"))
    while n_buckets > 1:
        n_buckets = math.ceil(n_buckets / bucket)
        level = settle(parts, "shard-sums")
        moved = settle(
            level.groupBy(F.floor(F.col("bucket") / bucket)).applyInPandas(
                _parts_in(shards), "bucket long, part int, onward int"
            ),
            "shard-moves",
        )
        above = F.floor(F.col("bucket") / bucket).alias("bucket")
        placed = placed.join(moved, ["bucket", "part"]).select(above, "member", F.col("onward").alias("part"))
        entries = level.select("bucket", F.posexplode("sums").alias("part", "bytes")).join(moved, ["bucket", "part"])
        entries = entries.withColumn("part", F.col("onward"))
        parts = entries.groupBy(above).agg(F.array(*vector).alias("sums"))
    return placed.select("member", F.col("part").alias("shard"))


def shard(documents: DataFrame, shards: int = SHARDS, bucket: int = BUCKET) -> DataFrame:
    """Each document's ``size, text_crc32, shard`` and its ``slot`` in the shard, gapless from 0.

    Rows take slots in an order that follows from their ids alone: first by a hash of
    the id, then by the id. So many tasks number one shard, each one range of hashes.
    """
    text = F.coalesce("text", F.lit(""))
    sized = settle(
        documents.select(
            "doc_id",
            F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text")).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            # Texts that share this key by chance would only be kept together.
            F.xxhash64(text).alias("member"),
        ).withColumn("size", F.col("size") + 1),
        "shard-sizes",
    )
    groups = settle(sized.groupBy("member").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = settle(sized.join(assign(groups, shards, bucket), "member"), "shard-placed")
    return _slotted(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def _slotted(placed: DataFrame) -> DataFrame:
    ranges = max(1, math.ceil(placed.count() / NUMBERED))
    ranged = placed.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(ranges)))
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range")
    starts = settle(
        counts.select("shard", "range", (F.sum("n").over(before) - F.col("n")).alias("start")), "shard-starts"
    )
    own = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32")
    numbered = ranged.withColumn("own", F.row_number().over(own) - 1)
    return numbered.join(starts, ["shard", "range"]).withColumn("slot", F.col("start") + F.col("own"))
