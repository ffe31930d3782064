"""Every registered query of the core against its SQL, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__
from rivulet.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in queries.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    sql = queries.ORACLE[name]
    assert sorted(duck.sql(sql).columns) == columns
    picked = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(r) for r in duck.sql(f"SELECT {picked} FROM ({sql})").fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_core_query_is_registered():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) == set(queries.ORACLE)
