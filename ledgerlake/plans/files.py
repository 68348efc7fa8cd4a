"""Files of the kinds that the sources read, written by Spark tasks from the derived tables: listing, bundle, index, archives, snapshots."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.store import new_folder
from . import views
from .fixtures import derived

#: Members of an archive: three that are read, one that is too many, and one of another document.
MEMBERS = tuple(f"XBRL/PublicDoc/{m}.xbrl" for m in range(4))
OTHER = "XBRL/AuditDoc/0.xbrl"


def listing_sheet(spark: SparkSession, sf_dir: str) -> str:
    """The exchange's sheet as CSV files, with headers and spaces as it has them."""
    path = new_folder(spark, "listing")
    c = derived(spark, sf_dir, "fx_companies").orderBy("seq")
    padded = F.concat(F.lit("　"), "name", F.lit(" "))
    c.select(F.lit("20010802").alias("日付"), F.col("code").alias("コード"), padded.alias("銘柄名"), F.col("market").alias("市場・商品区分"), F.col("industry").alias("33業種コード"), F.lit("-").alias("33業種区分")).write.csv(path, header=True)
    return path


def bundle(spark: SparkSession, sf_dir: str) -> str:
    """Companies as entries of text files; those of every ninth have an empty field."""
    path = new_folder(spark, "bundle")
    c = derived(spark, sf_dir, "fx_companies")
    field = lambda n, v: F.concat(F.lit(f"{n}:`"), v, F.lit("`"))
    industry = F.when(F.col("seq") % 9 == 0, "").otherwise(F.col("industry"))
    one = F.concat(F.lit("{"), F.concat_ws(",", field("code", F.col("code")), field("name", F.col("name")), field("market", F.col("market")), field("industry", industry)), F.lit("},"))
    c.select(one.alias("value")).write.text(path)
    return path


def filing_index(spark: SparkSession, sf_dir: str) -> str:
    """S3: one JSON object a day, in a folder of that day; a day's filings are one list."""
    path = new_folder(spark, "index")
    f = derived(spark, sf_dir, "fx_filings")
    item = F.struct(F.col("doc_id").alias("docID"), F.col("sec_code").alias("secCode"), F.col("doc_type_code").alias("docTypeCode"), F.col("submit_ts").alias("submitDateTime"), F.col("submit_date").alias("submitDate"), F.col("period_end").alias("periodEnd"))
    days = f.groupBy("fetch_day").agg(F.transform(F.array_sort(F.collect_list(F.struct("day_seq", item.alias("f")))), lambda x: x.f).alias("results"))
    days.write.partitionBy("fetch_day").json(path)
    return path


def archives(spark: SparkSession, sf_dir: str) -> str:
    """An archive for each annual report with facts, whose elements are dealt to MEMBERS by seq; that of every seventeenth order is cut in half."""
    path = new_folder(spark, "archives")
    wanted = views.annual(spark, sf_dir).select("doc_id", "o_orderkey", "fetch_day")
    f = derived(spark, sf_dir, "fx_facts").join(wanted, "doc_id")
    docs = f.groupBy("doc_id", "o_orderkey", "fetch_day").agg(F.array_sort(F.collect_list(F.struct("seq", "tag", "bucket", "value"))).alias("facts"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem, LocalFileSystem

        fs, at = (LocalFileSystem(), path[5:]) if path.startswith("file:") else FileSystem.from_uri(path)
        for b in batches:
            for doc_id, key, day, facts in zip(b["doc_id"], b["o_orderkey"], b["fetch_day"], b["facts"], strict=True):
                texts = {name: [] for name in MEMBERS}
                for x in facts:
                    when, span = x["bucket"].split("_")
                    ref = f"{'CurrentYear' if when == 'current' else 'PriorYear'}{span.capitalize()}_Member"
                    texts[MEMBERS[x["seq"] % 4]].append(f'<j:{escape(x["tag"])} contextRef="{ref}"> {x["value"]:,.0f}</j:{escape(x["tag"])}>')
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, elements in ((OTHER, ['<j:NetSales contextRef="CurrentYearDuration">1</j:NetSales>']), *texts.items()):
                        z.writestr(name, f'<x xmlns:j="ns">{"".join(elements)}</x>')
                data = out.getvalue()
                fs.create_dir(f"{at}/fetch_day={day}", recursive=True)
                with fs.open_output_stream(f"{at}/fetch_day={day}/{doc_id}.zip") as f:
                    f.write(data if key % 17 else data[: len(data) // 2])
            yield pd.DataFrame({"n": [len(b)]})

    docs.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return path


def one_file(rows: DataFrame, path: str) -> str:
    """Lines of text in the order of column at, as one file: what a web client loads."""
    rows.repartitionByRange(1, "at").sortWithinPartitions("at").select("value").write.text(path)
    fs = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    files = at.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return next(f.getPath().toString() for f in files if f.getPath().getName().startswith("part-"))


def _entries(rows: DataFrame, name: str, place: int, value) -> DataFrame:
    """at and value of the lines of one map: its name, a line for each row of key, and its end."""
    spark = rows.sparkSession
    edge = lambda k, text: spark.createDataFrame([(f"{place}{k}", text)], "at string, value string")
    last = rows.agg(F.max("key")).first()[0]
    line = F.concat(F.lit('"'), "key", F.lit('":'), F.to_json(value), F.when(F.col("key") != F.lit(last), ",").otherwise(""))
    return edge(0, f'"{name}": {{').union(rows.select(F.concat(F.lit(f"{place}1"), "key"), line)).union(edge(2, "},"))


def snapshot(spark: SparkSession, sf_dir: str) -> str:
    """The records of a run as one JSON file."""
    records = views.snapshot_records(spark, sf_dir).select(F.col("code").alias("key"), "record")
    edge = lambda k, text: spark.createDataFrame([(k, text)], "at string, value string")
    lines = edge("0", '{"generatedAt": "a \\"b\\" {c\\\\", "stats": {"n": 1}, ').union(_entries(records, "records", 1, F.col("record"))).union(edge("9", '"end": []}'))
    return one_file(lines, new_folder(spark, "snapshot"))


def market(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Quotes and fundamentals as one JSON file, and a copy of it that ends in the middle."""
    q = derived(spark, sf_dir, "fx_quotes").select(F.col("code").alias("key"), F.struct("close", F.col("previous_close").alias("previousClose"), F.col("change_percent").alias("changePercent"), "volume").alias("v"))
    f = derived(spark, sf_dir, "fx_fundamentals").select(F.col("code").alias("key"), F.struct("eps", "bps", F.col("forecast_eps").alias("forecastEps")).alias("v"))
    edge = lambda k, text: spark.createDataFrame([(k, text)], "at string, value string")
    head = edge("0", '{"status": "ready", ').union(_entries(q, "quotes", 1, F.col("v")))
    whole = head.union(_entries(f, "fundamentals", 2, F.col("v"))).union(edge("9", '"end": []}'))
    return one_file(head, new_folder(spark, "broken")), one_file(whole, new_folder(spark, "market"))
