"""Every registered governance query against its oracle SQL on DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from quarrylens.plans import registry
from quarrylens.session import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows, names):
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(str(value(r[names.index(n)])) for n in sorted(names)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    ran = duck.execute(SQL[name])
    names = [c[0] for c in ran.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(ran.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
