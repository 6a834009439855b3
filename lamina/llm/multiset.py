"""Document fingerprints that add up: a homomorphic multiset hash of paragraphs.

A text is the multiset of its paragraphs: pieces between line breaks, and within a line
after a full stop, question or exclamation mark. Each paragraph hashes to a wide vector,
and the fingerprint is the sum of the vectors, lane by lane:

- 128 lanes of plus or minus one, modulo 2^16. Their scalar product estimates how many
  paragraphs two texts share, so they give the likeness, to about 0.09.
- 8 lanes of 32 hash bits, modulo 2^32, which tell texts with different paragraphs apart.

Sums do not depend on the order, and a paragraph is put in or taken out by adding or
subtracting its vector: an edited text's fingerprint is the text's, without the paragraphs
from the edit on, and with those that came instead. Only built-in functions are used.

Rows meet the next one by id in ranges of ids, cut at percentiles, so ranges hold about
equally many rows whatever the ids are.

Edge cases: a null text is the empty one; a text without paragraphs has the zero
fingerprint; two such texts have likeness 1, and one of them against another text 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm.tables import settle

SIGNS = 128
SIGN_MOD = 1 << 16
WIDE = 8
WIDE_MOD = 1 << 32
#: Where paragraphs end.
BREAKS = r"[\r\n]+|(?<=[.!?])\s+"
#: Document ids of a range, and the percentiles at most that ranges are cut at; where there are more ranges, the
#: ids between two percentiles are cut into equally wide ones.
BUCKET, PERCENTILES = 4096, 2048
#: Two lanes of 32 bits fit a long, so sums stay whole up to 2^31 paragraphs.
PAIR = 1 << 32 | 1


def paragraphs(text: Column) -> Column:
    pieces = F.split(F.coalesce(text, F.lit("")), BREAKS)
    return F.filter(F.transform(pieces, F.trim), lambda p: p != "")


def _hashes(units: Column, salt: int) -> Column:
    return F.transform(units, lambda p: F.xxhash64(p, F.lit(salt)))


def _sum(hashes: Column, part) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + part(h))


def with_lanes(df: DataFrame, text: Column, lanes: str) -> DataFrame:
    """Adds the fingerprint of ``text`` as an array of longs, each below its lane's modulus."""
    units = f"{lanes}_units"
    return with_lanes_of(df.withColumn(units, paragraphs(text)), F.col(units), lanes).drop(units)


def with_lanes_of(df: DataFrame, units: Column, lanes: str) -> DataFrame:
    """Adds the fingerprint of an array of paragraphs."""
    salts = range(SIGNS // 64 + WIDE // 2)
    hashed, size = f"{lanes}_hashed", f"{lanes}_size"
    df = df.withColumns({hashed: F.struct(*[_hashes(units, s).alias(f"h{s}") for s in salts]), size: F.size(units).cast("long")})
    n = F.col(size)
    signs = []
    for s in range(SIGNS // 64):
        for i in range(32):
            pair = _sum(
                F.col(f"{hashed}.h{s}"),
                lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR)),
            )
            for ones in (pair.bitwiseAND(F.lit(WIDE_MOD - 1)), F.shiftrightunsigned(pair, 32)):
                signs.append(F.pmod(2 * ones - n, F.lit(SIGN_MOD)))
    wide = []
    for s in range(SIGNS // 64, SIGNS // 64 + WIDE // 2):
        hashes = F.col(f"{hashed}.h{s}")
        for half in (
            _sum(hashes, lambda h: h.bitwiseAND(F.lit(WIDE_MOD - 1))),
            _sum(hashes, lambda h: F.shiftrightunsigned(h, 32)),
        ):
            wide.append(F.pmod(half, F.lit(WIDE_MOD)))
    return df.withColumn(lanes, F.array(*signs, *wide)).drop(hashed, size)


def _modulus(i: Column) -> Column:
    return F.when(i < SIGNS, F.lit(SIGN_MOD)).otherwise(F.lit(WIDE_MOD)).cast("long")


def insert(lanes: Column, others: Column) -> Column:
    """The fingerprint of both multisets together."""
    both = F.zip_with(lanes, others, lambda a, b: a + b)
    return F.transform(both, lambda x, i: F.pmod(x, _modulus(i)))


def delete(lanes: Column, others: Column) -> Column:
    """The fingerprint after the others' paragraphs are taken out."""
    both = F.zip_with(lanes, others, lambda a, b: a - b)
    return F.transform(both, lambda x, i: F.pmod(x, _modulus(i)))


def shown(lanes: Column) -> Column:
    """Hex digits: four for each sign lane, eight for each wide lane."""
    width = lambda i: F.when(i < SIGNS, F.lit(4)).otherwise(F.lit(8))
    digits = F.transform(lanes, lambda x, i: F.lpad(F.hex(x), width(i), F.lit("0")))
    return F.lower(F.array_join(digits, ""))


def signed(lanes: Column) -> Column:
    """The sign lanes as numbers around zero."""
    half = SIGN_MOD // 2
    return F.transform(F.slice(lanes, 1, SIGNS), lambda x: (F.pmod(x + half, F.lit(SIGN_MOD)) - half).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def likeness(lanes: Column, others: Column) -> Column:
    """The cosine of two texts' paragraph multisets as the sign lanes estimate it, 0 to 1."""
    a, b = signed(lanes), signed(others)
    norms = F.sqrt(_dot(a, a) * _dot(b, b))
    cosine = F.when(norms > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / norms))).otherwise(0.0)
    return F.when(lanes == others, F.lit(1.0)).otherwise(cosine)


def in_ranges(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows by id range: adds ``range`` and ``copied``, and shuffles the rows by range.

    A copy of each range's first rows is put after the range before it, so that the next row of
    every row is in its own range. Null ids form the first range.
    """
    low, high, n = documents.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ranges = max(1, math.ceil(n / bucket))
    parts = min(ranges, PERCENTILES)
    cuts: list[int] = []
    if parts > 1 and low is not None:
        wanted = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)
        cuts = sorted(set(documents.agg(wanted).first()[0]) - {low})
    ends = F.array(*[F.lit(c).cast("long") for c in [low or 0, *cuts, (high or 0) + 1]])
    doc_id = F.col("doc_id").cast("long")
    part = F.size(F.filter(F.slice(ends, 2, len(cuts)), lambda c: c <= doc_id)) if cuts else F.lit(0)
    each = -(-ranges // parts)
    begin, end = F.get(ends, part).cast("double"), F.get(ends, part + 1).cast("double")
    inside = F.least(F.floor((doc_id.cast("double") - begin) * each / (end - begin)), F.lit(each - 1))
    of = F.when(doc_id.isNull(), F.lit(-1)).otherwise(part * each + (inside if each > 1 else 0)).cast("long")
    heads = documents.select(of.alias("range"), "doc_id").groupBy("range").agg(F.min("doc_id").alias("head"))
    heads = settle(heads.withColumn("part", F.floor(F.col("range") / each)), "range-starts", ranges + 1)
    # Ranges follow one another between two percentiles, and these parts, few in any case, in one task.
    of_part = heads.groupBy("part").agg(F.max("range").alias("last"))
    ordered = Window.orderBy("part")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.coalesce(F.lag("last").over(ordered), F.last("last").over(whole))
    of_part = of_part.select("part", earlier.alias("earlier"))
    before = F.coalesce(F.lag("range").over(Window.partitionBy("part").orderBy("range")), F.col("earlier"))
    heads = settle(heads.join(of_part, "part").select("head", before.alias("before")), "range-heads", ranges + 1)
    copies = documents.join(heads, F.col("doc_id").eqNullSafe(F.col("head"))).select(
        *documents.columns, F.col("before").alias("range"), F.lit(True).alias("copied")
    )
    own = documents.select("*", of.alias("range"), F.lit(False).alias("copied"))
    return own.unionByName(copies).repartition("range")


def fingerprint_edits(documents: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half is the next text's first.

    The next text of the last document is the first's; a document alone is its own next.
    Null ids come before all others; rows of one id follow one another by text.
    """
    rows = in_ranges(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), bucket)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    # The last paragraph before the edit may go on behind it; those before it are the same in both texts.
    rows = rows.withColumns({"units": paragraphs(F.col("text")), "before": paragraphs(F.left("text", n - half))})
    rows = rows.withColumn("same", F.greatest(F.size("before") - 1, F.lit(0))).drop("before")
    rows = with_lanes_of(rows, F.slice("units", F.lit(1), F.col("same")), "kept")
    rows = with_lanes_of(rows, _from(F.col("units"), F.col("same")), "taken").drop("units")
    rows = rows.withColumn("lanes", insert(F.col("kept"), F.col("taken"))).drop("kept")
    order = Window.partitionBy("range").orderBy("copied", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select(
        "*", F.lead("text").over(order).alias("next_text"), F.lead("lanes").over(order).alias("next_lanes")
    ).where("not copied")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "lanes", "taken", "next_lanes", "same", edited.alias("edited")
    )
    rows = rows.withColumn("edited_units", paragraphs(F.col("edited")))
    rows = with_lanes_of(rows, _from(F.col("edited_units"), F.col("same")), "added")
    rows = rows.withColumn("edited_lanes", insert(delete(F.col("lanes"), F.col("taken")), F.col("added")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("lanes")).alias("fingerprint"),
        shown(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


def _from(units: Column, n: Column) -> Column:
    """The paragraphs behind the first ``n``."""
    return F.slice(units, n + 1, F.greatest(F.size(units) - n, F.lit(0)))
