"""Every catalogued query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from sleuthframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


def plain(value):
    """A value that compares alike from either engine."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return f"{float(value):.6g}"
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_gives_what_its_sql_gives(spark, duck, small, name):
    frame = catalogue.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    got = sorted([plain(row[c]) for c in columns] for row in frame.collect())
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([plain(row[i]) for i in at] for row in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    frame = catalogue.QUERIES[name](spark, small)
    rows = frame.collect()
    assert len(set(frame.columns)) == len(frame.columns)
    assert all(len(row) == len(frame.columns) for row in rows)
