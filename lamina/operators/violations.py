"""The rows behind a failed check, kept for inspection or left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.checks import Check, relationships, unique

#: The checks that single rows of a table can break.
OF_ROWS = ("not_null", "accepted_values", "unique", "relationships")
BROKEN = "_broken"


def label(check: Check) -> str:
    return f"{check.test}({', '.join(check.columns)})"


def tagged(df: DataFrame, checks: Sequence[Check], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``df`` with the names of the checks that each row breaks, as an array ``_broken``.

    Null and value checks are tested in the one pass over the rows. What a uniqueness or
    foreign-key check finds wrong are values, counted before any shuffle; the rows meet those
    values in a join that the runtime may broadcast or split. Checks of whole tables
    (freshness, queries) tag no row.
    """
    wanted = [c for c in checks if c.test in OF_ROWS]
    found: list[Column] = []
    for n, check in enumerate(wanted):
        broken = _broken_alone(check)
        if broken is None:
            df = _beside_values(df, check, tables or {}, f"_found_{n}")
            broken = F.col(f"_found_{n}").isNotNull()
        found.append(F.when(broken, F.lit(label(check))))
    names = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return df.withColumn(BROKEN, names).drop(*[f"_found_{n}" for n in range(len(wanted))])


def _broken_alone(check: Check) -> Column | None:
    if check.test == "not_null":
        return F.col(check.column).isNull()
    if check.test == "accepted_values":
        return F.coalesce(~F.col(check.column).isin(list(check.values)), F.lit(False))
    return None


def _beside_values(df: DataFrame, check: Check, tables: Mapping[str, DataFrame], mark: str) -> DataFrame:
    """The rows, with ``mark`` set where their value is one that breaks the check."""
    columns = list(check.columns)
    if check.test == "unique":
        values = unique(df, *columns)
    else:
        values = relationships(df, check.column, tables[check.parent], check.parent_column)
    return df.join(values.select(*columns, F.lit(True).alias(mark)), columns, "left").select(*df.columns, mark)


def violations(
    tables: Mapping[str, DataFrame], checks: Sequence[Check], keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One row per check and row that breaks it: test, model, column, value, key and the row as JSON.

    ``value`` is what the check looks at, ``key`` the columns that ``keys`` names for the model,
    both as JSON. The rows returned by a query check are its violations, with no value and key.
    The checks' counts follow from this: null rows, and different values of the others.
    """
    out = []
    for model in dict.fromkeys(c.model for c in checks):
        own = [c for c in checks if c.model == model]
        of_rows = [c for c in own if c.test in OF_ROWS]
        if of_rows:
            out.append(_listed(tables[model], model, of_rows, tables, list((keys or {}).get(model, ()))))
        for check in own:
            if check.test == "query":
                rows = tables[model].sparkSession.sql(check.sql, **tables)
                nothing = F.lit(None).cast("string")
                out.append(rows.select(*_named(check), nothing.alias("value"), nothing.alias("key"), _json(rows.columns).alias("row")))
    if not out:
        raise ValueError("no check looks at rows")
    return reduce(DataFrame.unionAll, out)


def _listed(df: DataFrame, model: str, checks: list[Check], tables: Mapping[str, DataFrame], key: list[str]) -> DataFrame:
    columns = df.columns
    rows = tagged(df, checks, tables).where(F.size(BROKEN) > 0)
    each = F.array(
        *[
            F.when(
                F.array_contains(BROKEN, label(c)),
                F.struct(*_named(c), _json(c.columns).alias("value")),
            )
            for c in checks
        ]
    )
    chosen = _json(key) if key else F.lit(None).cast("string")
    return rows.select(F.inline(F.array_compact(each)), chosen.alias("key"), _json(columns).alias("row")).select(
        "test", "model", "column", "value", "key", "row"
    )


def _named(check: Check) -> list[Column]:
    return [
        F.lit(check.test).alias("test"),
        F.lit(check.model).alias("model"),
        F.lit(", ".join(check.columns)).alias("column"),
    ]


def _json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"})


def counted(found: DataFrame) -> DataFrame:
    """The failures per check as ``run_checks`` counts them, of the checks that have any."""
    return found.groupBy("test", "model", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("value").alias("values")
    ).select(
        "test",
        "model",
        "column",
        F.when(F.col("test").isin("not_null", "query"), F.col("rows")).otherwise(F.col("values")).alias("failures"),
    )


def accepted(df: DataFrame, checks: Sequence[Check], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """The rows that break no check, with the columns they came with."""
    return tagged(df, checks, tables).where(F.size(BROKEN) == 0).drop(BROKEN)
