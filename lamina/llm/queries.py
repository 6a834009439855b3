"""The driver's queries over the given tables, one per operator, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import (
    bands,
    bpe,
    fixity,
    gridcodes,
    interaction,
    line_crf,
    mixing,
    multiset,
    readable,
    shards,
    simhash,
    toolcalls,
    urlfilter,
)
from lamina.llm.tables import table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Every so many pages the second replica has lost a record, or has a byte changed.
LOST, CHANGED = 101, 67


def importable(spark: SparkSession) -> None:
    """Let Python workers that did not inherit the path import this package."""
    given = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, given]))


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archive records, audited against a replica with planted losses and changes."""
    primary = fixity.archive(fixity.hashed(fixity.record(table(spark, sf_dir, "pages"))))
    changed = F.sha2(F.concat("hash", F.lit("!")), 256)
    replica = primary.where(f"page_id is null or page_id % {LOST} <> 7").withColumn(
        "hash", F.when(F.col("page_id") % CHANGED == 5, changed).otherwise(F.col("hash"))
    )
    columns = ["file", "offset", "length", "hash"]
    return fixity.audit(primary.select(*columns), replica.select(*columns))


OP1_SQL = f"""
    with framed as (
        select page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
            || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
            || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
            || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as payload
        from pages),
    hashed as (select page_id, strlen(payload)::bigint as length, sha256(payload) as hash from framed),
    ours as (
        select *, coalesce((page_id // {fixity.FILE_IDS})::varchar, 'x' || substr(hash, 1, 3)) as file,
            (sum(length) over (partition by coalesce((page_id // {fixity.FILE_IDS})::varchar, 'x' || substr(hash, 1, 3))
                order by page_id, hash rows unbounded preceding) - length)::bigint as "offset"
        from hashed),
    theirs as (
        select page_id, length, file, "offset",
            case when page_id % {CHANGED} = 5 then sha256(hash || '!') else hash end as hash
        from ours where page_id is null or page_id % {LOST} <> 7),
    top as (select 1 as levels_below, max("offset" + length) as bytes from ours),
    {{nodes}}
    found as (
        select file, "offset", ours.length, ours.hash, theirs.hash as replica_hash
        from ours left join theirs using (file, "offset") where ours.hash is distinct from theirs.hash)
    select file, "offset", length, hash, replica_hash,
        case when replica_hash is null then 'missing' else 'damaged' end as finding, root, replica_root
    from found join ({{root_of}}) using (file)
"""


def _op1_sql(levels: int = 6) -> str:
    """The roots as nested hashes: every level, and the one that covers the largest file is the root."""
    nodes = []
    for side in ("ours", "theirs"):
        nodes.append(
            f"{side}_0 as (select file, \"offset\" // {fixity.RANGE} as node, sha256(string_agg(\"offset\" || ':' || hash, "
            f"chr(10) order by \"offset\", hash)) as hash from {side} group by all)"
        )
        for level in range(1, levels):
            nodes.append(
                f"{side}_{level} as (select file, node // {fixity.FANOUT} as node, sha256(string_agg(node || ':' || hash, "
                f"chr(10) order by node)) as hash from (select file, node as node, hash from {side}_{level - 1}) "
                f"group by file, node // {fixity.FANOUT})"
            )
    covered = [fixity.RANGE * fixity.FANOUT**level for level in range(levels)]
    choice = " ".join(
        f"when (select bytes from top) <= {covered[level]} then {{side}}_{level}.hash" for level in range(levels)
    )
    joins = {
        side: f"(select f.file, case {choice.format(side=side)} end as hash from (select distinct file from {side}) f "
        + " ".join(f"left join {side}_{level} on {side}_{level}.file = f.file and {side}_{level}.node = 0" for level in range(levels))
        + ")"
        for side in ("ours", "theirs")
    }
    root_of = (
        f"select o.file, o.hash as root, t.hash as replica_root from {joins['ours']} o "
        f"left join {joins['theirs']} t on o.file = t.file"
    )
    return OP1_SQL.format(nodes=", ".join(nodes) + ",", root_of=root_of)


def op2_target_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 9) for c in ("weight", "probability")}
    )


OP2_SQL = f"select * replace (round(weight, 9) as weight, round(probability, 9) as probability) from ({mixing.sql('documents')})"


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return bands.verdicts(table(spark, sf_dir, "documents"))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.shown(F.col("bits")).alias("fingerprint"), "component_id")


def op6_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    rows = shards.shard(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return readable.page_texts(table(spark, sf_dir, "pages"))


def op8_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    calls, results = toolcalls.calls_of(table(spark, sf_dir, "conversations"))
    return toolcalls.linked(calls, results, toolcalls.SCHEMAS)


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_grid_cell_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return gridcodes.compress(table(spark, sf_dir, "embeddings"))


def op12_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return interaction.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_merkle_fixity,
        op2_target_mix,
        op3_line_crf,
        op4_compression_bands,
        op5_simhash_components,
        op6_differencing_shards,
        op7_tree_scoring,
        op8_bpe_transducer,
        op9_tool_calls,
        op10_multiset_fingerprints,
        op11_grid_cell_codes,
        op12_survival_words,
        op13_blocked_bloom_urls,
    )
}

SQL = {
    "op1_merkle_fixity": _op1_sql(),
    "op2_target_mix": OP2_SQL,
    "op11_grid_cell_codes": gridcodes.sql(),
    "op12_survival_words": interaction.SQL,
    "op13_blocked_bloom_urls": urlfilter.SQL,
}
