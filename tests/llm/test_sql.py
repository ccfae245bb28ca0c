"""The registered queries that have SQL give its rows on the small tables."""

import os

import duckdb
import pytest

from blockloom.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("BLOCKLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cursor = db.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) t")
    assert got == sorted(map(tuple, cursor.fetchall()), key=str)
