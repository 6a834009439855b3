"""Merkle fixity audit of archive replicas.

Records are hashed as they lie in an archive file. A file's records form a tree over
ordered offset ranges: ranges of 64 KiB at the bottom, then 16 ranges to one, up to the
whole file. Replicas are compared at the roots, and only the branches that differ are
descended, level by level, down to the records that are damaged, missing or in excess.

A range holds few entries by construction: records do not overlap, so a range of 64 KiB
has at most one per record header, and every higher node has at most 16 children. Only
hashes, offsets and lengths are shuffled, never the payload.

Edge cases: a null payload, address or id is framed as an empty one; records that claim
the same offset are ordered by their hash; a null file is a file, and a null hash a hash
like any other, so a record that lost it is damaged; records with a null offset have no
place in their file's tree, so they form a tree of their own, in the order of their
hashes, and where they differ they are missing or in excess; a file that only one replica
has differs at its root and all its records are reported; empty replicas have no files;
columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.tables import settle

#: Bytes of the lowest ranges, and ranges below one higher node.
RANGE = 65_536
FANOUT = 16
#: What stands for a null hash and, in front of a file's key, for a null offset.
NO_HASH, NO_OFFSET = "none", "n"
#: Ranges that the records of a file without offsets are spread over.
PLACES = 1 << 20
#: Ids of one archive file in the layout of ``archive``.
FILE_IDS = 500


def record(pages: DataFrame) -> DataFrame:
    """Pages framed as archive records: ``page_id, payload``."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.concat(head, html, F.lit("\r\n\r\n")).alias("payload"))


def hashed(records: DataFrame) -> DataFrame:
    """``page_id, length, hash`` of each record's bytes."""
    return records.select(
        "page_id",
        F.octet_length("payload").cast("long").alias("length"),
        F.sha2("payload", 256).alias("hash"),
    )


def archive(hashes: DataFrame, ids: int = FILE_IDS) -> DataFrame:
    """Lays records out in files by ranges of ids: adds ``file`` and ``offset``.

    Records without an id are spread over files of their own by their hash.
    """
    spread = F.concat(F.lit("x"), F.substring("hash", 1, 3))
    file = F.coalesce(F.floor(F.col("page_id") / ids).cast("string"), spread)
    before = Window.partitionBy("file").orderBy("page_id", "hash")
    return hashes.withColumn("file", file).withColumn(
        "offset", F.sum("length").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    )


def _ordered(key: str, value: str) -> Column:
    """One hash over the entries of a node, in order."""
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e[key].cast("string"), e[value])), "\n"), 256)


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes ``file, node, hash`` per level, lowest first; the last level has one node per file."""
    nodes = records.groupBy("file", F.floor(F.col("offset") / RANGE).alias("node")).agg(
        _ordered("offset", "hash").alias("hash")
    )
    out = [settle(nodes, "tree")]
    for _ in range(levels - 1):
        above = F.floor(F.col("node") / FANOUT)
        nodes = out[-1].groupBy("file", above.alias("above")).agg(_ordered("node", "hash").alias("hash"))
        out.append(settle(nodes.withColumnRenamed("above", "node"), "tree"))
    return out


def levels_for(bytes_of_file: int) -> int:
    """Levels until one node covers a file of so many bytes."""
    levels, covered = 1, RANGE
    while covered < bytes_of_file:
        levels, covered = levels + 1, covered * FANOUT
    return levels


def _differing(ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose hashes differ or that only one side has."""
    theirs = theirs.select(*key, F.col("hash").alias("other"))
    return ours.select(*key, "hash").join(theirs, key, "full").where(~F.col("hash").eqNullSafe(F.col("other")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The records in which two replicas differ, found from the roots down.

    Both have ``file, offset, length, hash`` and the primary's ``page_id``. Returns per
    differing record the file, offset and length, the finding (damaged, missing, excess),
    both hashes and both roots of its file.
    """
    kind = primary.schema["file"].dataType
    primary, replica = settle(_placed(primary), "primary"), settle(_placed(replica), "replica")
    ends = [side.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0 for side in (primary, replica)]
    levels = levels_for(max(ends))
    ours, theirs = tree(primary, levels), tree(replica, levels)
    roots = settle(
        _differing(ours[-1], theirs[-1], ["file", "node"]).select(
            "file", "node", F.col("hash").alias("root"), F.col("other").alias("replica_root")
        ),
        "roots",
    )
    suspects = roots.select("file", "node")
    for level in reversed(range(levels - 1)):
        above = F.floor(F.col("node") / FANOUT).alias("above")
        branch = suspects.withColumnRenamed("node", "above")
        below = [
            side[level].withColumn("above", above).join(branch, ["file", "above"], "left_semi") for side in (ours, theirs)
        ]
        suspects = settle(_differing(*below, ["file", "node"]).select("file", "node"), "suspects")
    leaf = F.floor(F.col("offset") / RANGE)
    found = [
        side.withColumn("node", leaf).join(suspects, ["file", "node"], "left_semi") for side in (primary, replica)
    ]
    rows = _compared(*found).join(roots.drop("node"), "file")
    # The record's own values, in place of the keys that were compared.
    return rows.withColumns(
        {
            "offset": F.when(F.startswith("file", F.lit(NO_OFFSET)), F.lit(None)).otherwise(F.col("offset")),
            "file": F.when(F.substring("file", 2, 1) == "=", F.expr("substring(file, 3)")).cast(kind),
            **{c: F.when(F.col(c) != NO_HASH, F.col(c)) for c in ("hash", "replica_hash")},
        }
    )


def _placed(records: DataFrame) -> DataFrame:
    """``file, offset, length, hash`` without nulls: a key that tells null files and offsets apart from others."""
    known = F.when(F.col("offset").isNull(), F.lit(NO_OFFSET)).otherwise(F.lit("o"))
    name = F.coalesce(F.concat(F.lit("="), F.col("file").cast("string")), F.lit("?"))
    digest = F.coalesce("hash", F.lit(NO_HASH))
    # Records without an offset lie as far apart as their hashes, so no range of them is large.
    place = F.pmod(F.xxhash64(digest), F.lit(PLACES)) * RANGE
    return records.select(
        F.concat(known, name).alias("file"),
        F.coalesce(F.col("offset").cast("long"), place).alias("offset"),
        F.coalesce(F.col("length").cast("long"), F.lit(0)).alias("length"),
        digest.alias("hash"),
    )


def _compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records by offset; equal records at one offset cancel, however many there are."""
    key = ["file", "offset", "hash"]
    counted = [
        side.groupBy(*key).agg(F.count("*").alias(n), F.max("length").alias(f"{n}_length"))
        for side, n in ((ours, "ours"), (theirs, "theirs"))
    ]
    both = reduce(lambda a, b: a.join(b, key, "full"), counted).na.fill(0, ["ours", "theirs"])
    left = both.where("ours <> theirs").groupBy("file", "offset").agg(
        F.max(F.coalesce("ours_length", "theirs_length")).alias("length"),
        F.min(F.when(F.col("ours") > F.col("theirs"), F.col("hash"))).alias("hash"),
        F.min(F.when(F.col("ours") < F.col("theirs"), F.col("hash"))).alias("replica_hash"),
    )
    finding = (
        F.when(F.col("replica_hash").isNull(), F.lit("missing"))
        .when(F.col("hash").isNull(), F.lit("excess"))
        .otherwise(F.lit("damaged"))
    )
    return left.withColumn("finding", finding)
