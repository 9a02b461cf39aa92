"""Every catalogued query with SQL must equal that SQL, run by DuckDB on the same files."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as contract
from holdfast.plans import oracles
from holdfast.plans.catalog import BUILDERS, presented

TABLES = ("customer", "events")
ORACLES = oracles.all_sql()
SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def canonical(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [
        tuple(None if isinstance(t[i], float) and math.isnan(t[i]) else t[i] for i in order)
        for t in tuples
    ]
    return sorted(cells, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, workspace, database):
    found = presented(BUILDERS[name](workspace))
    wanted = database.sql(ORACLES[name])
    types = {f.name: SQL_TYPES[f.dataType.simpleString()] for f in found.schema}
    assert types == dict(zip(wanted.columns, map(str, wanted.types)))
    ours = canonical(found.columns, [tuple(r) for r in found.collect()])
    theirs = canonical(wanted.columns, wanted.fetchall())
    assert ours == theirs


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 15
