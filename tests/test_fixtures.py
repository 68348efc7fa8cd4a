"""Derived tables over keys that are larger than those of the given tables."""

from datetime import datetime

import duckdb
import pytest
from ledgerlake.plans import fixtures
from ledgerlake.plans.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

#: Keys that a pad of five (companies) or eight places (documents) would make equal.
KEYS, ORDERS = (10_000, 100_000, 100_001, 1_000_000), (12_345_678, 123_456_780, 123_456_781, 1_234_567_800)


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    at = tmp_path_factory.mktemp("large")
    con = duckdb.connect()
    rows = lambda made: ", ".join(f"({', '.join(map(repr, r))})" for r in made)
    tables = {
        "nation": "select cast(n as int) as n_nationkey, 'N' || n as n_name, 0 as n_regionkey from range(3) t(n)",
        "customer": f"select cast(k as bigint) as c_custkey, 'Customer#' || k as c_name, cast(k % 3 as int) as c_nationkey, 0e0 as c_acctbal, 'AUTO' as c_mktsegment from (values {rows((k,) for k in KEYS)}) t(k)",
        "orders": f"select cast(o as bigint) as o_orderkey, cast(c as bigint) as o_custkey, 'O' as o_orderstatus, 0e0 as o_totalprice, timestamp '{datetime(2001, 3, 1)}' as o_orderdate, '1-URGENT' as o_orderpriority from (values {rows(zip(ORDERS, KEYS, strict=True))}) t(o, c)",
        "lineitem": f"select cast(o as bigint) as l_orderkey, cast(p as bigint) as l_partkey, cast(1 as int) as l_linenumber, 1000.5e0 + p as l_extendedprice from (values {rows((o,) for o in ORDERS)}) t(o), range(4) s(p)",
        "events": f"select cast(k + e as bigint) as event_id, timestamp '2001-03-01' + interval (e) day as ts, cast(k as bigint) as user_id, 'x' as event_type, 100e0 + e as value, '' as props from (values {rows((k,) for k in KEYS)}) t(k), range(3) s(e)",
    }
    for name, made in tables.items():
        con.execute(f"create table {name} as {made}")
        con.execute(f"copy {name} to '{at}/{name}.parquet' (format parquet)")
    return con, str(at)


def test_ids_are_distinct(spark, large):
    _, sf = large
    assert {r.code for r in fixtures.derived(spark, sf, "fx_companies").collect()} == {str(k) for k in KEYS}
    assert {r.doc_id for r in fixtures.facts(spark, sf).select("doc_id").distinct().collect()} == {f"S{o}" for o in ORDERS}
    assert {r.doc_id for r in fixtures.derived(spark, sf, "fx_filings").collect()} == {f"S{o}" for o in ORDERS}


@pytest.mark.parametrize(("name", "rows"), [("company_view", 4), ("watchlist", 3), ("compare_pivot", 18), ("kpi_cells", 48)])
def test_one_row_a_company(spark, large, name, rows):
    con, sf = large
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    got = sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))
    assert got == sorted(map(str, found.fetchall()))
    assert len(got) == rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fact_pick", "fact_wide", "fact_parse"])
def test_line_items_are_dealt_once(spark, sf, name):
    """By document, before they are exploded: facts themselves are in no exchange."""
    text = plan(QUERIES[name](spark, sf))
    assert text.count("Exchange ") == 1 and "Generate" not in text[text.index("Exchange ") :]


def test_parsing_is_compiled(spark, sf):
    """No lambda, which is interpreted row by row, and no map that is searched from its start."""
    text = plan(QUERIES["fact_parse"](spark, sf))
    assert "lambda" not in text and "keys:" not in text and "try_element_at" not in text


def test_rounding_is_compiled_and_exact(spark, sf):
    """As SQL's round, halves and their neighbours among the values, without a decimal for each."""
    values = [0.0, 0.49999999999999994, 0.5, 0.5000000000000001, 1.4999999999999998, 1.5, 2.5, 4503599627370495.5, 9007199254740993.0, 1e300, float("inf")]
    values += [k / 16 for k in range(400)] + [9.995 * 100, 1.005 * 100, 84197.04 * 0.001]
    df = spark.createDataFrame([(s * v,) for v in values for s in (1, -1)] + [(None,)], "v double")
    assert not [r for r in df.select("v", F.round("v").alias("a"), fixtures.whole(F.col("v")).alias("b")).collect() if r.a != r.b]
    for name in ("fact_pick", "fact_wide"):
        assert "round(" not in plan(QUERIES[name](spark, sf)), name
