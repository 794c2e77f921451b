"""Every registered query that has SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from plugscope import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(Q.oracle_sql())


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: str(list(x)) if hasattr(x, "__iter__") and not isinstance(x, str) else "NULL" if x is None or x != x else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert normal(Q.queries()[name](spark, SF).toPandas()).equals(normal(con.sql(Q.oracle_sql()[name]).df()))


def test_all_have_docs_or_sql():
    assert set(Q.oracle_sql()) <= set(Q.queries())
