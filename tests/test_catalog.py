import os

import duckdb
import pytest

from blockloom.plans import catalog, more  # noqa: F401

DATA = os.environ.get("BLOCKLOOM_TESTDATA", "/root/testdata/sf0.001")


def normal(rows):
    def cell(x):
        return "null" if x is None else f"{x:.5f}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    cursor = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.ORACLE_SQL[name]}) t")
    assert normal(rows) == normal(cursor.fetchall())
