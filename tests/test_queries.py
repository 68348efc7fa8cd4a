"""Every registered query of the library proper against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from ledgerlake.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(f"{float(x):.10g}") if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(v is not None, str(v)) for v in r]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["code", "name", "s_overall"] and df.count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
