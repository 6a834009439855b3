"""Filter interaction audit by truth-table survival words.

Five filters give 32 subsets. A document's survival word has bit S set if it passes every
filter of subset S: all bits, without those of the subsets that hold a filter it fails.
How many documents survive each subset is the count of every bit position over all words,
which carry-save adders find many words at a time: three words become one of sums and one
of carries, until few are left per power of two. What any order of the filters keeps,
removes and loses at any step is a difference of two such counts, so the documents are
read once for all orders.

Whether a text is identical to that of a smaller id is asked table-wide: the least id of
each text's digest is found by an aggregate that combines before it shuffles, and a row is
looked up by its own id together with its digest, so a text on a third of all rows makes no
hot key. Tasks give 32 counts per part and label; no document reaches the driver.

Edge cases: a null text is empty and has no words; a null lang is the empty string; a null
id is neither smaller nor greater than any, so it never fails E, and it has no label; rows of
one id and one text do not fail for each other; a document is good or toxic if any of its
label rows says so. An empty table has no parts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.tables import settle

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ALL = SUBSETS - 1
SPACES = r"[\x20\x09-\x0D]+"
#: Parts whose counts a task holds before it passes them on.
HELD = 2_000


def passing(letter: str) -> int:
    """The word of a document that fails this filter only: the subsets without it."""
    bit = 1 << FILTERS.index(letter)
    return sum(1 << subset for subset in range(SUBSETS) if not subset & bit)


def failures(text: Column) -> dict[str, Column]:
    """Whether a text, empty for null, fails each filter that looks at the text alone."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def survival(failing: dict[str, Column]) -> Column:
    """The survival word as a long."""
    word = F.lit((1 << SUBSETS) - 1).cast("long")
    for letter, fails in failing.items():
        word = word.bitwiseAND(F.when(fails, F.lit(passing(letter))).otherwise(F.lit((1 << SUBSETS) - 1)).cast("long"))
    return word


def words_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, word``: every document's survival word."""
    text = F.coalesce("text", F.lit(""))
    rows = settle(
        documents.select(
            "doc_id",
            F.coalesce("lang", F.lit("")).alias("part"),
            survival(failures(text)).alias("word"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "survival",
    )
    named = rows.where("doc_id is not null")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    # Both joins sort and merge at any size, so that costs grow evenly and a repeated id can be split.
    met = named.join(firsts.hint("merge"), ["doc_id", "digest"], "left").join(marks.hint("merge"), "doc_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    repeated = F.lit(passing("E")).cast("long")
    word = F.when(yes("first"), F.col("word")).otherwise(F.col("word").bitwiseAND(repeated))
    found = met.select("part", yes("good").alias("good"), yes("toxic").alias("toxic"), word.alias("word"))
    no = F.lit(False)
    return found.unionByName(
        rows.where("doc_id is null").select("part", no.alias("good"), no.alias("toxic"), "word")
    )


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each of the 32 bits, by carry-save addition."""
    counts, weight, level = np.zeros(32, np.int64), 1, words
    positions = np.arange(32, dtype=np.uint32)
    while len(level):
        carries = []
        while len(level) >= 3:
            n = len(level) // 3
            a, b, c = level[:n], level[n : 2 * n], level[2 * n : 3 * n]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * n :]])
        for word in level:
            counts += weight * ((word >> positions) & np.uint32(1)).astype(np.int64)
        level = np.concatenate(carries) if carries else level[:0]
        weight *= 2
    return counts


def survivors(words: DataFrame) -> DataFrame:
    """``part, every, good, toxic``: survivors of each subset, of all documents, good ones and toxic ones."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            codes = batch.column(0).dictionary_encode()
            parts, of = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
            labels = [np.ones(len(of), bool)] + [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
            word = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint32)
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(parts) + 1))
            for i, part in enumerate(parts):
                at = order[ends[i] : ends[i + 1]]
                for label, marked in zip(("every", "good", "toxic"), labels):
                    key = (part, label)
                    held[key] = held.get(key, 0) + bit_counts(word[at[marked[at]]])
            if len(held) > HELD:
                yield _rows(held)
                held = {}
        if held:
            yield _rows(held)

    rows = words.mapInArrow(counted, "part string, label string, counts array<long>")
    sums = F.array(*[F.sum(F.get("counts", F.lit(i))) for i in range(SUBSETS)])
    by_label = rows.groupBy("part", "label").agg(sums.alias("counts"))
    return by_label.groupBy("part").agg(
        *[F.max(F.when(F.col("label") == label, F.col("counts"))).alias(label) for label in ("every", "good", "toxic")]
    )


def _rows(held: dict[tuple[str, str], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part for part, _ in held], pa.string()),
            "label": pa.array([label for _, label in held], pa.string()),
            "counts": pa.array([c.tolist() for c in held.values()], pa.list_(pa.int64())),
        }
    )


def _subset(letters: Column) -> Column:
    """The subset of the filters whose letters are there."""
    return sum((F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))


def _shapley(letter_bit: Column) -> Column:
    """What the filter removes, summed over all orders."""
    total = F.lit(0).cast("long")
    for before in range(SUBSETS):
        size = before.bit_count()
        if size < len(FILTERS):
            orders = factorial(size) * factorial(len(FILTERS) - 1 - size)
            lost = F.get("every", F.lit(before)) - F.get("every", F.lit(before).bitwiseOR(letter_bit))
            # A subset that holds the filter loses nothing to it.
            total = total + orders * lost
    return total


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed and lost.

    All but the last aggregate's few rows, one per part, is gone before orders are written out.
    """
    counts = survivors(words_of(documents, labels))
    of_filter = F.transform(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), _shapley)
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(FILTERS))), " ")
    steps = (
        counts.withColumn("all_orders", of_filter)
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    )
    before = _subset(F.substring("filter_order", F.lit(1), F.col("step") - 1))
    letter = F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumns({"before": before, "place": letter})
    steps = steps.withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("place")))
    upto = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda of: F.get(of, F.col("before")) - F.get(of, upto)
    failing = F.get("every", F.lit(0)) - F.get("every", F.col("bit"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("every", upto).alias("kept"),
        lost("every").alias("removed"),
        (failing - lost("every")).alias("redundant"),
        (F.get("every", F.lit(ALL) - F.col("bit")) - F.get("every", F.lit(ALL))).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.element_at("all_orders", F.col("place")).alias("shapley"),
    )


SQL = """
    with d as (
        select doc_id, coalesce(lang, '') part, coalesce(text, '') t,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) n,
            len(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) u,
            min(doc_id) over (partition by coalesce(text, '')) least
        from documents),
    l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by doc_id),
    f as (
        select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
            case when n < 100 then 'A' else '' end
            || case when 100 * u < 80 * n then 'B' else '' end
            || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 'C' else '' end
            || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
            || case when d.doc_id > least then 'E' else '' end fails
        from d left join l on d.doc_id = l.doc_id),
    c as (select part, good, toxic, fails, count(*) m from f group by all),
    letters as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
    orders as (
        select a.x || b.x || c.x || d.x || e.x filter_order
        from letters a, letters b, letters c, letters d, letters e
        where length(replace(replace(replace(replace(replace('ABCDE', a.x, ''), b.x, ''), c.x, ''), d.x, ''), e.x, '')) = 0),
    steps as (
        select filter_order, step::int step, substr(filter_order, step, 1) x, substr(filter_order, 1, step - 1) earlier
        from orders, range(1, 6) r(step)),
    cells as (
        select part, filter_order, step, x, good, toxic, fails, m, contains(fails, x) hit,
            fails <> '' and length(translate(fails, earlier, '')) < length(fails) gone
        from c, steps),
    rows as (
        select part, filter_order, step, x,
            sum(case when not gone and not hit then m else 0 end)::bigint kept,
            sum(case when not gone and hit then m else 0 end)::bigint removed,
            sum(case when gone and hit then m else 0 end)::bigint redundant,
            sum(case when fails = x then m else 0 end)::bigint unique_fails,
            sum(case when not gone and hit then m * good else 0 end)::bigint good_lost,
            sum(case when not gone and hit then m * toxic else 0 end)::bigint toxic_lost
        from cells group by part, filter_order, step, x)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) over (partition by part, x))::bigint shapley
    from rows
"""
