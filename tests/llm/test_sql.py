"""The queries that have SQL against it, over whole tables."""

import glob
import os

import duckdb
import pytest
from ledgerlake.llm import queries

SF = "/root/testdata/sf0.01"


def plain(x):
    return float(f"{float(x):.10g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want and want
