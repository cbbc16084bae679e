"""Each query on the driver's tables gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from codefacts.plans import cases, oracle

ORACLE_SQL, QUERIES = oracle.ORACLE_SQL | cases.ORACLE_SQL, oracle.QUERIES | cases.QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return int(x) if isinstance(x, bool) else x

    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
