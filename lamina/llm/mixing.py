"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic. Raking multiplies the
cells' token weights so that their sums over each margin meet that margin's targets, one
margin after the other, round by round. No cell's weight may ask for more tokens than the
wanted part of all tokens lets its own give, so a step looks for the factor that meets a
value's target with every cell at the smaller of its scaled weight and that bound: the
cells are ordered by how soon they reach it, and the factor lies between two of them. A
document is kept with the probability of its cell, its weight over that bound, so the expected
tokens of each value are its target share of the wanted part.

Only cells are raked: their number is that of the sources times the languages times the
topics, not of the documents, so a hot source costs nothing after the first aggregation,
which combines before it shuffles. Up to FEW_CELLS of them are raked in one task, whose
windows need no shuffle; more are shuffled by margin, where a value's cells must fit a task.
All steps are built-in functions.

Targets are either given per margin, as weights by value, or follow from the data: each
value's tokens to a power below one, which raises small sources. A value without a given
target keeps its own share. A value that has fewer tokens than it should give gives all
of them, and the others of its margin share the rest in proportion. The topic is the documents'
column of that name, if they have one, and otherwise follows from what a text contains. A null
source, language, topic or text is a value of its own; a document without words has no tokens and its
cell's probability, zero if the cell has no tokens. Targets that are met one by one but not all at once, as
where a source has one topic only, end as near as the last round comes, and a warning names the largest
miss; ``misses`` gives each value's. Documents draw by a hash of their id, so repeated ids go together.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.tables import settle

MARGINS = ("source", "lang", "topic")
#: Powers of the tokens that the targets are in proportion to.
FLATTEN = {"source": 0.7, "lang": 0.5, "topic": 0.8}
#: Rounds over the margins; a round takes about four fifths of what is missed away.
ROUNDS = 16
#: How far beyond its bound a cell is set where its value gives all that it has.
PINNED = 1e6
#: Rounds between two writes of the cells, and the cells that one task may rake.
ROUNDS_AT_ONCE, FEW_CELLS = 4, 200_000
#: Part of all tokens to keep.
KEEP = 0.5
SEED = 42
#: Part of its target that a value may miss without a warning.
MISS = 1e-6

#: Topics in order of precedence, each with what its texts contain.
TOPICS = {
    "legal": ("License", "Copyright", "rights reserved"),
    "contact": ("@", "http://", "https://"),
    "tabular": (" | ",),
    "marked": ("***", "%%%", "!!"),
}
OTHER_TOPIC = "prose"

WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, topics: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    topic = F.lit(OTHER_TOPIC)
    for name, parts in reversed(topics.items()):
        found = F.lit(False)
        for part in parts:
            found = found | F.coalesce(F.contains(text, F.lit(part)), F.lit(False))
        topic = F.when(found, F.lit(name)).otherwise(topic)
    return topic


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cells_of(documents: DataFrame) -> DataFrame:
    """Tokens of each cell, from ``source, lang, topic, tokens``."""
    return documents.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens"))


def targets(cells: DataFrame, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Adds each margin's target share of its cell's value."""
    given = given or {}
    for margin in MARGINS:
        of_value = Window.partitionBy(margin)
        cells = cells.withColumn(f"{margin}_tokens", F.sum("tokens").over(of_value))
    for margin in MARGINS:
        own = f"{margin}_tokens"
        wanted = F.pow(F.col(own), F.lit(FLATTEN[margin]))
        for value, weight in given.get(margin, {}).items():
            wanted = F.when(F.col(margin) == value, F.lit(float(weight))).otherwise(wanted)
        cells = cells.withColumn(f"{margin}_target", wanted)
    return cells


def _shares(cells: DataFrame, keep: float) -> DataFrame:
    """Adds each margin's ``_share``: the target's part of the wanted tokens, or all that the value has if that is less.

    The factor of a margin's targets grows while further values come to give all that they have.
    Each cell carries its part of its value, so sums over the cells are sums over the values.
    """
    tokens = cells.agg(F.sum("tokens")).first()[0]
    wanted = keep * (tokens or 0.0)
    part = {m: F.count("*").over(Window.partitionBy(m)) for m in MARGINS}
    has = {m: F.col(f"{m}_tokens") / F.lit(wanted) if wanted > 0 else F.lit(0.0) for m in MARGINS}
    cells = cells.withColumn("bound", F.col("tokens") / F.lit(wanted) if wanted > 0 else F.lit(0.0))
    cells = settle(cells.withColumns({f"{m}_part": part[m] for m in MARGINS}), "cell-parts")
    factors, given_all = dict.fromkeys(MARGINS, 0.0), None
    while True:
        sums = []
        for m in MARGINS:
            target, all_given = F.col(f"{m}_target"), _gives_all(has[m], m, factors[m])
            sums += [
                F.sum(F.when(all_given, has[m] / F.col(f"{m}_part"))),
                F.sum(F.when(~all_given, target / F.col(f"{m}_part"))),
                F.count(F.when(all_given, 1)),
            ]
        found = cells.agg(*sums).first()
        if list(found[2::3]) == given_all:
            break
        given_all = list(found[2::3])
        for m, filled, still_open in zip(MARGINS, found[::3], found[1::3]):
            factors[m] = max(0.0, 1.0 - (filled or 0.0)) / still_open if still_open else math.inf
    shares = {
        f"{m}_share": F.when(_gives_all(has[m], m, factors[m]), has[m]).otherwise(
            F.col(f"{m}_target") * F.lit(factors[m] if math.isfinite(factors[m]) else 0.0)
        )
        for m in MARGINS
    }
    return cells.withColumns(shares).drop(*[f"{m}_part" for m in MARGINS])


def _gives_all(has: Column, margin: str, factor: float) -> Column:
    target = F.col(f"{margin}_target")
    return (target > 0) & (target * F.lit(factor) >= has) if math.isfinite(factor) else target > 0


def rake(cells: DataFrame, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """Adds ``weight``, ``probability`` and the margins' ``_share`` to cells with targets.

    A cell at its bound remembers the weight that it would have without, so that a later step may take it down again.
    """
    n = cells.count()
    raked = _shares(cells, keep).withColumn("free", F.col("tokens"))
    for done in range(0, rounds, ROUNDS_AT_ONCE):
        if n <= FEW_CELLS:
            raked = raked.coalesce(1)
        for _ in range(done, min(done + ROUNDS_AT_ONCE, rounds)):
            for margin in MARGINS:
                raked = _step(raked, margin)
        raked = settle(raked, "raking")
    weight = F.least("bound", "free")
    probability = F.when(F.col("bound") > 0, F.least(F.lit(1.0), weight / F.col("bound"))).otherwise(0.0)
    return raked.withColumns({"weight": weight, "probability": probability}).drop("bound", "free")


def _step(raked: DataFrame, margin: str) -> DataFrame:
    """Scales each value's cells by the factor with which they meet its share, none counted beyond its bound.

    A cell is full if the factor that fills it, applied to all, gives the share at most. Running sums in the order of
    these factors tell that for every cell at once.
    """
    value = Window.partitionBy(margin)
    upward = value.orderBy("fills").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = raked.withColumns(
        {
            "most": F.when(F.col("free") > 0, F.col("bound")).otherwise(0.0),
            "fills": F.when(F.col("free") > 0, F.col("bound") / F.col("free")).otherwise(0.0),
        }
    )
    later = F.sum("free").over(value) - F.sum("free").over(upward)
    given = F.sum("most").over(upward) + F.col("fills") * F.greatest(F.lit(0.0), later)
    cells = cells.withColumn("full", given <= F.col(f"{margin}_share"))
    filled = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(value)
    still_open = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("free"))).over(value)
    cells = cells.withColumns({"filled": filled, "still_open": still_open})
    scaled = F.col("free") * (F.col(f"{margin}_share") - F.col("filled")) / F.col("still_open")
    free = F.when(F.col("still_open") > 0, scaled).otherwise(F.col("most") * PINNED)
    return cells.withColumn("free", free).drop("most", "fills", "full", "filled", "still_open")


def misses(rated: DataFrame, keep: float = KEEP) -> DataFrame:
    """``margin, value, target, share, expected``: parts of the wanted tokens as asked, as they can be met, and as drawn."""
    expected = F.sum(F.col("probability") * F.col("tokens"))
    of_margins = [
        rated.groupBy(F.col(m).alias("value"))
        .agg(F.first(f"{m}_target").alias("target"), F.first(f"{m}_share").alias("share"), expected.alias("expected"))
        .select(F.lit(m).alias("margin"), "value", "target", "share", "expected")
        for m in MARGINS
    ]
    values = of_margins[0].unionByName(of_margins[1]).unionByName(of_margins[2])
    asked = values.groupBy("margin").agg(F.sum("target").alias("asked"))
    # The sum over all cells is one row.
    known = asked.crossJoin(rated.agg((F.sum("tokens") * keep).alias("wanted")))
    return values.join(known, "margin").select(
        "margin",
        "value",
        F.when(F.col("asked") > 0, F.col("target") / F.col("asked")).alias("target"),
        "share",
        F.when(F.col("wanted") > 0, F.col("expected") / F.col("wanted")).alias("expected"),
    )


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _marked(documents: DataFrame) -> DataFrame:
    topic = F.col("topic") if "topic" in documents.columns else topic_of(F.col("text"))
    return documents.withColumns({"topic": topic, "tokens": tokens_of(F.col("text"))})


def calibrate(cells: DataFrame, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``source, lang, topic, weight, probability`` of the cells, as a stored table.

    The planner broadcasts it to the documents only if its files are small enough.
    """
    rated = rake(settle(targets(settle(cells, "cells"), given), "cell-targets"), keep)
    parts = [f"{margin}_{part}" for margin in MARGINS for part in ("target", "share")]
    rated = settle(rated.select(*MARGINS, "weight", "probability", "tokens", *parts), "cell-probabilities")
    off = [F.max(F.when(F.col(c) > 0, F.abs(F.col("expected") / F.col(c) - 1))) for c in ("target", "share")]
    of_target, of_share = misses(rated, keep).agg(*off).first()
    if of_target is not None and of_target > MISS:
        text = "a value's expected share misses its target by %.3g of it, and what its tokens allow by %.3g"
        logging.getLogger(__name__).warning(text, of_target, of_share)
    return rated.drop("tokens", *parts)


def _with_cell(marked: DataFrame, cells: DataFrame) -> DataFrame:
    renamed = cells.select(*[F.col(m).alias(f"cell_{m}") for m in MARGINS], "weight", "probability")
    same = [F.col(m).eqNullSafe(F.col(f"cell_{m}")) for m in MARGINS]
    return marked.join(renamed, same).drop(*[f"cell_{m}" for m in MARGINS])


def mix(documents: DataFrame, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Every document with its cell, the cell's weight and probability, and whether it is drawn."""
    marked = settle(_marked(documents).select("doc_id", *MARGINS, "tokens"), "marked")
    drawn = draw(F.col("doc_id")) < F.col("probability")
    return _with_cell(marked, calibrate(cells_of(marked), keep, given)).withColumn("sampled", drawn)


def sample(documents: DataFrame, keep: float = KEEP, given: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The drawn documents, with the columns they came with."""
    topic = [c for c in documents.columns if c == "topic"]
    kept = documents.select(F.struct(*documents.columns).alias("document"), "doc_id", "source", "lang", "text", *topic)
    marked = _marked(kept).drop("text")
    cells = calibrate(cells_of(marked), keep, given)
    return _with_cell(marked, cells).where(draw(F.col("doc_id")) < F.col("probability")).select("document.*")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _share_sql(m: str) -> list[str]:
    """The margin's shares by running sums over its values, in the order in which they come to give all that they have."""
    upward = "over (order by gives rows between unbounded preceding and current row)"
    return [
        f"{m}_values as (select {m}, any_value({m}_target) target, sum(tokens) / (select wanted from total) has, "
        f"case when any_value({m}_target) > 0 then sum(tokens) / (select wanted from total) / any_value({m}_target) "
        f"else 0 end gives from wanted group by {m})",
        f"{m}_given as (select *, sum(has) {upward} + gives * greatest(0, sum(target) over () - sum(target) {upward}) <= 1 "
        f"gives_all from {m}_values)",
        f"{m}_shares as (select {m}, case when gives_all then has else target * (1 - sum(case when gives_all then has else 0 end) "
        f"over ()) / sum(case when gives_all then 0 else target end) over () end {m}_share from {m}_given)",
    ]


def sql(table: str, keep: float = KEEP, rounds: int = ROUNDS) -> str:
    """``mix`` for DuckDB, with the rounds written out; ``table`` is a query or name with the columns of documents."""
    cases = " ".join(
        "when " + " or ".join(f"contains(text, {_quoted(p)})" for p in parts) + f" then {_quoted(name)}"
        for name, parts in TOPICS.items()
    )
    steps = [
        f"marked as (select doc_id, source, lang, case {cases} else {_quoted(OTHER_TOPIC)} end topic, "
        f"coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint tokens from {table})",
        "cells as (select source, lang, topic, sum(tokens)::double tokens from marked group by all)",
        "wanted as (select *, "
        + ", ".join(f"pow(sum(tokens) over (partition by {m}), {FLATTEN[m]}) {m}_target" for m in MARGINS)
        + " from cells)",
        f"total as (select {keep} * sum(tokens) wanted from cells)",
        *[sql for m in MARGINS for sql in _share_sql(m)],
        "w0 as materialized (select w.source, w.lang, w.topic, tokens free, tokens / (select wanted from total) bound, "
        + ", ".join(f"{m}_share" for m in MARGINS)
        + " from wanted w "
        + " ".join(f"join {m}_shares on w.{m} is not distinct from {m}_shares.{m}" for m in MARGINS)
        + ")",
    ]
    n = 0
    for _ in range(rounds):
        for m in MARGINS:
            upward = f"over (partition by {m} order by fills rows between unbounded preceding and current row)"
            steps.append(
                f"w{n + 1} as materialized (select * exclude (most, fills, is_full, filled, still_open) replace (case when "
                f"still_open > 0 then free * ({m}_share - filled) / still_open else most * {PINNED} end as free) from (select *, "
                f"sum(case when is_full then most else 0 end) over (partition by {m}) filled, "
                f"sum(case when is_full then 0 else free end) over (partition by {m}) still_open from (select *, "
                f"sum(most) {upward} + fills * greatest(0, sum(free) over (partition by {m}) - sum(free) {upward}) "
                f"<= {m}_share is_full from (select *, case when free > 0 then bound else 0 end most, "
                f"case when free > 0 then bound / free else 0 end fills from w{n}))))"
            )
            n += 1
    steps.append(
        "cell as (select source s, lang l, topic t, least(bound, free) weight, "
        f"case when bound > 0 then least(1.0, least(bound, free) / bound) else 0 end probability from w{n})"
    )
    draw_sql = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint / 4294967296.0"
    return (
        f"with {', '.join(steps)} select doc_id, source, lang, topic, tokens, weight, probability, "
        f"{draw_sql} < probability sampled from marked join cell on source is not distinct from s "
        "and lang is not distinct from l and topic is not distinct from t"
    )
