"""Schema-on-write casts and the required-columns filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The declared columns of ``df``, cast to the declared types, and those in ``keep`` as they are.

    A value that its type cannot hold raises; none turns into null. Decimals
    round half away from zero. Text longer than a ``varchar(n)`` raises unless
    only spaces are cut off. Columns that have their type already are taken as they
    are, so filters on them still reach the scan.
    """
    stored = {f.name.lower(): f.dataType for f in df.schema}
    declared = [F.col(f.name) if stored.get(f.name.lower()) == f.dataType else _fit(f).alias(f.name) for f in schema]
    return df.select(*declared, *keep)


def plain_type(dtype: T.DataType) -> T.DataType:
    """The type as Parquet stores it: ``varchar(n)`` is a string."""
    return T.StringType() if isinstance(dtype, T.VarcharType) else dtype


def require_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a value in every one of ``columns``.

    Written as plain null tests, which the Parquet scan takes; ``na.drop`` counts
    nulls in one expression and is not pushed down.
    """
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def _fit(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, T.VarcharType):
        text, length = c.cast("string"), field.dataType.length
        return (
            F.when(F.length(text) <= length, text)
            .when(F.length(F.rtrim(text)) <= length, F.substring(text, 1, length))
            .when(text.isNotNull(), _reject(field))
        )
    # NaN, for one, casts to a null decimal without an error.
    return F.coalesce(c.cast(field.dataType), F.when(c.isNotNull(), _reject(field)))


def _reject(field: T.StructField) -> Column:
    return F.raise_error(F.lit(f"{field.name}: value does not fit {field.dataType.simpleString()}"))
