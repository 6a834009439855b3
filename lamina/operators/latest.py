"""Keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_by(df: DataFrame, keys: Sequence[str], order: str, tiebreak: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``; a null order wins.

    Equal orders fall to the greatest ``tiebreak`` and then to the other columns, so a retried
    task picks the same row. The result is that of ``row_number() = 1``, taken as the greatest
    struct per key: a task keeps one row per key before the shuffle, so a key with most of the
    rows costs no more than any other. Columns that cannot be compared, such as maps, are left
    out of the comparison; their text as JSON decides between rows that are equal otherwise.
    """
    if not tiebreak:
        raise ValueError("latest_by needs at least one tiebreak column")
    ranked = list(dict.fromkeys([order, *tiebreak]))
    parts = []
    for c in ranked:
        # Struct comparison puts null below every value, the flag puts it above.
        parts += [F.col(c).isNull().alias(f"_no_{c}"), F.col(c)]
    used = {c.lower() for c in (*keys, *ranked)}
    others = [f for f in df.schema if f.name.lower() not in used]
    parts += [F.col(f.name) for f in others if _comparable(f.dataType)]
    rest = [F.to_json(F.struct(F.col(f.name))).alias(f"_text_{f.name}") for f in others if not _comparable(f.dataType)]
    named = {k.lower() for k in keys}
    payload = [F.col(c) for c in df.columns if c.lower() not in named]
    if not rest:
        # All columns can be compared, so the rank holds them, once.
        columns = [F.col(c) if c.lower() in named else F.col(f"_latest.{c}").alias(c) for c in df.columns]
        return df.groupBy(*keys).agg(F.max(F.struct(*parts)).alias("_latest")).select(columns)
    latest = F.max_by(F.struct(*payload), F.struct(*parts, *rest)).alias("_latest")
    columns = [F.col(c) if c.lower() in named else F.col(f"_latest.{c}").alias(c) for c in df.columns]
    return df.groupBy(*keys).agg(latest).select(columns)


def _comparable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _comparable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
