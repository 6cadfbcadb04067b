"""Every query against its SQL, on small tables."""

import os

import pytest

import __spark_entry__

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{ROOT}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    own = QUERIES[name](spark, ROOT)
    columns = sorted(own.columns)
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(row[i]) for i in at) for row in found.fetchall()), key=repr)
    assert sorted((tuple(plain(row[c]) for c in columns) for row in own.collect()), key=repr) == expected


def test_sql_has_queries():
    assert not SQL.keys() - QUERIES.keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
