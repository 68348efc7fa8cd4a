"""Company, filing and fact tables derived from the given tables, in SQL that both engines run.

`{name}` stands for a given table; fx_ names stand for tables of this module. `days(a, b)` are the days from b to a.
Codes and ids are padded, never cut (lpad cuts longer texts), so that each company and each document has one of its own at any size.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.store import changed

#: (element, period, factor) of the facts that a line item can stand for.
ELEMENTS = (
    ("NetSales", "duration", 10.0), ("OperatingIncome", "duration", 1.0), ("ProfitLoss", "duration", 0.6), ("Assets", "instant", 20.0),
    ("NetAssets", "instant", 8.0), ("NetCashProvidedByUsedInOperatingActivities", "duration", 1.2), ("Inventories", "instant", 2.0),
    ("NotesAndAccountsReceivableTrade", "instant", 2.0), ("CashAndDeposits", "instant", 3.0), ("ShortTermBorrowings", "instant", 1.0),
    ("LongTermBorrowings", "instant", 2.0), ("BasicEarningsLossPerShare", "duration", 0.001),
)

_TAGS = " union all ".join(
    f"select {2 * i + k} as k, '{tag}' as tag, '{when}_{period}' as bucket, {factor!r}e0 as f" for i, (tag, period, factor) in enumerate(ELEMENTS) for k, when in enumerate(("current", "previous"))
)

TABLES = {
    "fx_companies": """
select c_custkey as seq,
 case when c_custkey < 1000 and c_custkey % 17 = 0 then concat(lpad(cast(c_custkey as varchar(20)),3,'0'),'A')
      when c_custkey < 1000 and c_custkey % 29 = 0 then concat(lpad(cast(c_custkey as varchar(20)),4,'0'),'5')
      when c_custkey < 10000 then lpad(cast(c_custkey as varchar(20)),4,'0') else cast(c_custkey as varchar(20)) end as code,
 concat(c_name, case when c_custkey % 41 = 0 then ' ETF' when c_custkey % 43 = 0 then ' REIT' else '' end) as name,
 case c_mktsegment when 'BUILDING' then 'PRO Market' when 'MACHINERY' then 'グロース（内国株式）'
   when 'FURNITURE' then 'スタンダード（内国株式）' when 'HOUSEHOLD' then 'ETF・ETN' else 'プライム（内国株式）' end as market,
 case n_nationkey when 0 then '銀行業' when 1 then '小売業' when 2 then '化学' when 3 then '機械' else n_name end as industry
from {customer} join {nation} on c_nationkey = n_nationkey""",
    "fx_filings": """
select concat('S', case when o_orderkey < 100000000 then lpad(cast(o_orderkey as varchar(20)),8,'0') else cast(o_orderkey as varchar(20)) end) as doc_id, o_orderkey, c.seq as company_seq, c.code as company_code, concat(substr(c.code,1,4),'0') as sec_code,
 case when o_orderpriority in ('1-URGENT','2-HIGH','3-MEDIUM') then '120' else '140' end as doc_type_code,
 cast(o_orderdate as varchar(19)) as submit_ts, cast(null as varchar(19)) as submit_date, cast(cast(o_orderdate as date) as varchar(10)) as period_end, cast(o_orderdate as date) as fetch_day,
 days(cast('2001-08-02' as date), cast(o_orderdate as date)) as day_offset,
 row_number() over (partition by cast(o_orderdate as date) order by o_orderkey) - 1 as day_seq
from {orders} join fx_companies c on o_custkey = c.seq""",
    "fx_tags": _TAGS,
    "fx_facts": """
select concat('S', case when l_orderkey < 100000000 then lpad(cast(l_orderkey as varchar(20)),8,'0') else cast(l_orderkey as varchar(20)) end) as doc_id, l_orderkey,
 (cast(l_linenumber as bigint) * 4294967296 + cast(round(l_extendedprice * 100) as bigint)) * 32 + k as seq,
 tag, bucket, round(l_extendedprice * f) as value
from {lineitem} cross join fx_tags
where (l_linenumber * 7 + k * 3 + l_partkey) % 4 = 0""",
    "fx_records": """
select code, doc_id as document_id, submit_ts as filed_at from (
 select f.company_code as code, f.doc_id, f.submit_ts, row_number() over (partition by f.company_code order by f.day_offset, f.doc_id) as rn
 from fx_filings f where f.day_offset >= 45 and f.company_seq % 3 <> 0) t where rn = 1""",
    "fx_quotes": """
select c.code, t.close, t.previous_close, (t.close / nullif(t.previous_close, 0) - 1) * 100 as change_percent, t.volume from (
 select user_id, value as close, value * 7919e1 as volume, lag(value) over (partition by user_id order by ts, event_id) as previous_close,
  row_number() over (partition by user_id order by ts desc, event_id desc) as rn from {events}) t
join fx_companies c on c.seq = t.user_id where rn = 1""",
    "fx_fundamentals": """
select code, 1e0 + seq % 40 as eps, 10e0 + seq % 90 as bps,
 case when seq % 4 = 0 then null when seq % 7 = 0 then -1e0 else 1.1e0 * (1 + seq % 40) end as forecast_eps
from fx_companies where seq % 5 <> 0""",
}


def _needed(text: str) -> list[str]:
    """The tables of this module that a text uses, each after those that it uses itself."""
    wanted: set[str] = set()
    for name in reversed(TABLES):
        if any(re.search(rf"\b{name}\b", t) for t in (text, *(TABLES[n] for n in wanted))):
            wanted.add(name)
    return [n for n in TABLES if n in wanted]


def sql(body: str, more: str = "") -> str:
    """DuckDB: body over this module's tables; more holds further `name as (...)` parts."""
    parts = [f"{n} as ({TABLES[n]})" for n in _needed(more + body)] + ([more] if more else [])
    text = (f"with {', '.join(parts)} " if parts else "") + body
    text = re.sub(r"\bdays\((cast\('[^']*' as date\)), (cast\(\w+ as date\))\)", r"date_diff('day', \2, \1)", text)
    return re.sub(r"\{([a-z]+)\}", r"\1", text)


#: Bytes of line item files for each task that has whole documents: about 300,000 line items, 1.8 million facts.
DEALT = 4 << 20


def whole(x: Column) -> Column:
    """SQL's round to whole numbers, halves away from zero: what floor leaves of a double is exact, and no decimal is made of each value."""
    size = F.abs(x)
    below = F.floor(size).cast("double")
    near = F.when(size < float(1 << 53), F.when(size - below >= 0.5, below + 1).otherwise(below)).otherwise(size)
    return F.signum(x) * near


def facts(spark: SparkSession, sf_dir: str, by_document: bool = False, **more: Callable[[str], str]) -> DataFrame:
    """fx_facts: six facts a line item, those of the 24 kinds k with k % 4 = (7 * l_linenumber + l_partkey) % 4; more gives further columns by
    element. seq is the place in a document; facts of a kind that share it have the same value.

    by_document: line items are dealt by doc_id before they are exploded, to tasks whose number grows with the files, so that aggregations by
    document need no exchange of the facts, which are six times as many and wider.
    """
    path = f"{sf_dir}/lineitem.parquet"
    digits = F.col("l_orderkey").cast("string")
    doc_id = F.concat(F.lit("S"), F.when(F.col("l_orderkey") < 10**8, F.lpad(digits, 8, "0")).otherwise(digits)).alias("doc_id")
    line = spark.read.parquet(path).select(doc_id, "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    cores = spark.sparkContext.defaultParallelism
    if by_document:
        line = line.repartition(max(cores, -(-changed(spark, [path])[0][1] // DEALT)), "doc_id")
    elif line.rdd.getNumPartitions() < cores:  # a file of one split would be exploded, and its facts worked out, by one task
        line = line.repartition(cores, "l_orderkey")
    kinds = [(tag, f"{when}_{period}", f) for tag, period, f in ELEMENTS for when in ("current", "previous")]
    step = F.explode(F.sequence(F.lit(0), F.lit(len(kinds) // 4 - 1))).alias("j")
    # what all facts of a line item share is worked out before they are exploded
    start = (F.col("l_linenumber").cast("long") * (1 << 32) + whole(F.col("l_extendedprice") * 100).cast("long")) * 32
    rows = line.select("doc_id", "l_orderkey", "l_extendedprice", start.alias("start"), ((F.col("l_linenumber") * 7 + F.col("l_partkey")) % 4).alias("r"), step)
    k = (F.col("j") * 4 + F.col("r")).cast("int")
    of_kind = lambda values: F.get(F.array(*map(F.lit, values)), k)
    tag, bucket, factor = zip(*kinds, strict=True)
    return rows.select(
        "doc_id", "l_orderkey", (F.col("start") + k).alias("seq"), of_kind(tag).alias("tag"), of_kind(bucket).alias("bucket"),
        whole(F.col("l_extendedprice") * of_kind(factor)).alias("value"), *(of_kind([f(t) for t in tag]).alias(n) for n, f in more.items()),
    )


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of this module's tables as a DataFrame over the given ones."""
    if name == "fx_facts":
        return facts(spark, sf_dir)
    body = f"select * from {name}"
    parts = [f"{n} as ({TABLES[n]})" for n in _needed(body)]
    text = f"with {', '.join(parts)} {body}"
    given = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in set(re.findall(r"\{([a-z]+)\}", text))}
    return spark.sql(re.sub(r"\bdays\(", "datediff(", text), **given)
