"""Every registered query against its SQL; none may be empty."""

import duckdb
import pytest

from tessella import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "events", "lineitem", "benchmark"):
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(x):
    return x if isinstance(x, (str, bool)) or x is None else round(float(x), 5)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    res = con.execute(registry.ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted(str([plain(dict(zip(names, r))[c]) for c in cols]) for r in res.fetchall())
    have = sorted(str([plain(r[c]) for c in cols]) for r in got.collect())
    assert have and want == have


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
