"""The driver's queries and their SQL, one module per group of operators."""

from registered import incremental, models, quality, scalars, streams, tables

GROUPS = (scalars, models, tables, incremental, quality, streams)


def all_queries() -> dict:
    return {name: query for group in GROUPS for name, query in group.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.SQL.items()}
