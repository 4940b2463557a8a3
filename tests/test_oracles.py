"""Every registered query against the same query in SQL."""

import math

import duckdb
import pytest

from geostrata import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, sf_dir, con, name):
    found = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = lambda got: sorted(str([plain(v) for v in r]) for r in got)
    assert rows(found.select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
