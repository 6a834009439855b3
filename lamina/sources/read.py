"""Readers: declared external tables, literal rows and CSV seeds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lamina.operators.conform import conform


@dataclass(frozen=True)
class Source:
    """A table that the models read but do not build."""

    name: str
    schema: T.StructType
    path: str | None = None


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """The declared columns of a source: Parquet at its path, or a catalog table.

    The files' own schema is read, so a declared column that they lack raises, as does
    a value that its declared type cannot hold.
    """
    stored = spark.table(source.name) if source.path is None else spark.read.parquet(source.path)
    return conform(stored, source.schema)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A relation given in the program text."""
    return spark.createDataFrame(list(rows), schema)


def read_seed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line, read as text and cast to the declared types.

    An empty field is null. A row with too few or too many fields raises.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.schema(text).csv(path, header=True, enforceSchema=False, mode="FAILFAST")
    return conform(rows, schema)
