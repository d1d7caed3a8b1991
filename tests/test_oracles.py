"""Every registered query of the library proper against its SQL, on the smallest tables."""

import duckdb
import pytest

from codegov.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[names].astype(object).where(x[names].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    assert len(got) > 0
