"""Registered queries against their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from __spark_entry__ import _registered
from catalog.common import forgotten

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
REGISTERED = _registered()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def normal(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def text(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "NULL"
        return repr(value) if isinstance(value, float) else str(value)

    return sorted(tuple(text(row[i]) for i in order) for row in rows)


def test_forget_sets_are_not_empty(spark, data):
    """Else the forgetting queries would compare an unchanged model."""
    for name in ("event", "line"):
        assert forgotten(name, spark, data).count() > 0


@pytest.mark.parametrize("name", [n for n, query in REGISTERED.items() if query.sql is not None])
def test_query_equals_sql(spark, data, oracle, name):
    query = REGISTERED[name]
    result = query.run(spark, data)
    mine = normal(result.columns, result.collect())
    cursor = oracle.execute(query.sql)
    names = [column[0] for column in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert mine == normal(names, cursor.fetchall())
