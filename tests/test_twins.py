"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest
from check import TABLES, rows_of

from corpuslens.plans.catalog import QUERIES, TWINS


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(TWINS[name])
    assert mine == rows_of(rel.columns, rel.fetchall())
