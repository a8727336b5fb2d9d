"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

from mosaiq import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(repr(round(r[i], 9)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, sf, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    want = oracle.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)
