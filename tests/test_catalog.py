"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import datetime

import duckdb
import pytest

from kawara import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return round(v, 6) if isinstance(v, float) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_names_are_those_of_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and "catalogue_slice" in catalog.QUERIES
