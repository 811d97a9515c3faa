"""Every query of the library against its SQL, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from rookery.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    assert got or name == "bad"
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        assert got == sorted((plain(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and set(QUERIES) <= set(queries)
    rows = entry.entry(spark).collect()
    assert [(r["id"], round(r["distance"], 6)) for r in rows if r["query_id"] == 0] == [(0, 0.0), (17, 1.331087), (225, 1.369745)]
