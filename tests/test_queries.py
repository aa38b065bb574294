"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from corpusgraph.plans import answers, ranking, registry, relational, retrieval, selection, understanding  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(table, columns):
    plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[c]) for c in columns) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]
    found = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert not got or sorted(got[0]) == sorted(columns)
    assert rows(got, sorted(columns)) == rows(want, sorted(columns))


def test_entry(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
