"""Every registered query against its SQL on the same tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def test_same_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def _family(name: str) -> str:
    name = name.lower()
    for family, names in {
        "text": ("string", "varchar"),
        "int": ("int", "integer"),
        "long": ("bigint", "long"),
        "ntz": ("timestamp_ntz", "timestamp"),
    }.items():
        if name in names:
            return family
    return name.replace(" ", "")


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    df = driver.queries()[name](spark, sf_dir)
    sql = driver.oracle_sql()[name]
    relation = duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    types = {f.name: _family(f.dataType.simpleString()) for f in df.schema}
    expected_types = {c: _family(str(t)) for c, t in zip(relation.columns, relation.types, strict=True)}
    assert types == expected_types
    found = Counter(tuple(r) for r in df.select(columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    expected = Counter(duck.sql(f"select {quoted} from ({sql})").fetchall())
    assert found == expected
    assert found
