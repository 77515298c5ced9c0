"""Every registered query against its SQL, on the smallest test data."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels".split()
TYPES = {
    "double": "DOUBLE",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


# Queries of the optional training-data operators have tests of their own.
NAMES = [n for n in entry.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is not None, repr(v)) for v in row])


def test_every_query_has_its_sql():
    assert set(NAMES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    expected = sql.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    found = in_order([tuple(r[c] for c in columns) for r in df.collect()])
    wanted = in_order([tuple(r[expected.columns.index(c)] for c in columns) for r in expected.fetchall()])
    assert found == wanted
    assert found or name == "turnover_change"
    assert not any(isinstance(v, float) and math.isnan(v) for row in found for v in row)


def test_entry(spark):
    df = entry.entry(spark)
    assert [round(r.delta_PEI, 2) for r in df.orderBy("year").collect() if r.delta_PEI is not None] == [
        0.06,
        -0.22,
        -0.35,
        0.46,
    ]
