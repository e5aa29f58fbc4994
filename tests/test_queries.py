"""Every registered siting query against its SQL oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

from sitewise.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return db


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = plain(got.select(*columns).collect())
    if name not in ORACLES:
        assert rows
        return
    found = oracle.execute(f"select {', '.join(columns)} from ({ORACLES[name]})")
    assert rows == plain(found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
