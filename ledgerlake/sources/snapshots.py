"""JSON snapshots of records, quotes and reports."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import rules
from ..functions.scalar import let
from .ranges import RANGE, read_entries
from .store import hadoop_path

METRIC = "struct<value:double,previousValue:double,trend:array<double>,comparisonLabel:string>"
RECORD = (
    "struct<code:string,companyName:string,documentId:string,documentType:string,filedAt:string,periodEnd:string,periodType:string,source:string,"
    f"sourceUrl:string,sourceDetail:string,metrics:map<string,{METRIC}>,history:array<struct<year:string,operatingMargin:double,roe:double,operatingCfMargin:double>>,"
    "valuation:struct<eps:double,bps:double,forecastEps:double>,quality:struct<policy:string,autoFilled:boolean,parserVersion:int>>"
)
FINANCIALS = f"struct<generatedAt:string,status:string,source:string,stats:map<string,double>,records:map<string,{RECORD}>>"
QUOTE = "struct<close:double,previousClose:double,changePercent:double,volume:double,date:string,source:string>"
FUNDAMENTALS = "struct<eps:double,bps:double,forecastEps:double>"
MARKET = f"struct<status:string,source:string,latestTradingDate:string,quotes:map<string,{QUOTE}>,fundamentals:map<string,{FUNDAMENTALS}>>"


def cleaned_text(c: Column) -> Column:
    """Without a byte order mark, and null where a value is NaN or infinite, which JSON doesn't have."""
    c = F.regexp_replace(c, "^﻿", "")
    for token in ("-Infinity", "Infinity", "NaN"):
        c = F.regexp_replace(c, rf"(?<=[:\[,])(\s*){token}(?=\s*[,\]\}}])", "$1null")
    return c


def parsed(primary: Column, fallback: Column, schema: str) -> Column:
    """The first of two texts that parses. Either is cleaned once, and the second only looked at where the first doesn't parse."""
    ok = lambda c: let(cleaned_text(c), lambda t: F.when(F.try_parse_json(t).isNotNull(), F.from_json(t, schema)))
    return F.coalesce(ok(primary), ok(fallback))


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def read_snapshot(spark: SparkSession, path: str, schema: str, fallback: str | None = None) -> DataFrame:
    """One row, column s, of a snapshot; the second path is used where the first is absent or can't be parsed."""
    read = lambda p: spark.read.text(p, wholetext=True).select(F.col("value")) if p and _exists(spark, p) else spark.createDataFrame([(None,)], "value string")
    both = read(path).crossJoin(read(fallback).withColumnRenamed("value", "other"))  # one row each
    return both.select(parsed(F.col("value"), F.col("other"), schema).alias("s"))


def _large(spark: SparkSession, path: str, step: int) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).getLen() > step


def _map_of(spark: SparkSession, path: str, fallback: str | None, schema: str, name: str, kind: str, step: int) -> DataFrame:
    """key and value (v) of one of a snapshot's maps. A file of more than step bytes is read in ranges; S8 holds for either way."""
    if _large(spark, path, step):
        found = read_entries(spark, path, step)
        if found is not None:
            value = F.from_json(cleaned_text(F.concat(F.lit('{"v":'), "value", F.lit("}"))), f"v {kind}")["v"]
            return found.filter(F.col("top") == name).select("key", value.alias("v"))
        return _map_of(spark, fallback, None, schema, name, kind, step) if fallback else spark.createDataFrame([], f"key string, v {kind}")
    if fallback and _large(spark, fallback, step):
        one = read_snapshot(spark, path, schema)
        if one.filter("s is null").count():
            return _map_of(spark, fallback, None, schema, name, kind, step)
        fallback = None
    return read_snapshot(spark, path, schema, fallback).select(F.explode(F.col("s")[name]).alias("key", "v"))


def read_records(spark: SparkSession, path: str, fallback: str | None = None, step: int = RANGE) -> DataFrame:
    """Code and record of a financial snapshot; none where the file is absent. Records under another code than their
    own are left out. A folder is one that write_snapshot wrote, whose lines are read in parallel; a file of more than step bytes is read in ranges of them."""
    if _is_folder(spark, path):
        lines = cleaned_text(F.regexp_replace("value", r",\s*$", ""))
        one = F.from_json(F.concat(F.lit("{"), lines, F.lit("}")), f"map<string,{RECORD}>")
        rows = spark.read.text(path).filter(F.col("value").rlike(r'^"[^"]*":\{"')).select(F.explode(one).alias("code", "record"))
    else:
        rows = _map_of(spark, path, fallback, FINANCIALS, "records", RECORD, step).toDF("code", "record")
    return rows.filter(F.coalesce(F.col("record.code") == F.col("code"), F.lit(True)))


def read_market(spark: SparkSession, path: str, fallback: str | None = None, step: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """Quotes and fundamentals by code."""
    read = lambda name, kind: _map_of(spark, path, fallback, MARKET, name, kind, step).select(F.col("key").alias("code"), "v.*")
    return read("quotes", QUOTE), read("fundamentals", FUNDAMENTALS)


def finite_everywhere(df: DataFrame) -> DataFrame:
    """Every double at any depth null where it isn't finite."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, x: clean(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*(clean(c[f.name], f.dataType).alias(f.name) for f in kind)))
        return c

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def read_stats(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """One row, column s: the statistics of a financial snapshot by name; an empty map where there are none."""
    if _is_folder(spark, path):
        head = spark.read.text(path).filter(F.col("value").startswith('{"'))
        s = head.select(F.from_json(F.concat(F.regexp_replace("value", r",\s*$", ""), F.lit("}")), FINANCIALS)["stats"].alias("s"))
    else:
        each = _map_of(spark, path, fallback, FINANCIALS, "stats", "double", RANGE)
        s = each.agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("s"))  # a few figures
    return s.agg(F.coalesce(F.first("s", ignorenulls=True), F.create_map().cast("map<string,double>")).alias("s"))


def _lines(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """A line of text for each row in the order of a unique key, all but the last with a comma."""
    last = rows.agg(F.max(key).alias("_last"))
    comma = F.when(F.col(key) != F.col("_last"), ",").otherwise("")
    dealt = rows.select(key, text.alias("_text")).repartitionByRange(key).sortWithinPartitions(key)
    return dealt.crossJoin(F.broadcast(last)).select(F.concat("_text", comma).alias("value"))  # one row


def _write_text(spark: SparkSession, parts: list[DataFrame | str], path: str) -> None:
    """Parts one after another as text; files in the order of their names make up the whole."""
    one = lambda p: p if isinstance(p, DataFrame) else spark.createDataFrame([(p,)], "value string").coalesce(1)
    reduce(DataFrame.union, map(one, parts)).write.mode("overwrite").text(path)


def write_snapshot(records: DataFrame, path: str, stats: dict[str, float] | None = None, generated_at: str = "", status: str = "ready", source: str = "EDINET") -> None:
    """(code, record) as a financial snapshot of finite values: a folder of text files that make up one JSON object in the order of their
    names, with a line for each record, so that it is written and read in parallel."""
    head = json.dumps({"generatedAt": generated_at, "status": status, "source": source, "stats": stats or {}}, ensure_ascii=False)
    clean = finite_everywhere(records)
    text = F.concat(F.to_json(F.struct("code")).substr(F.lit(9), F.length(F.to_json(F.struct("code"))) - 9), F.lit(":"), F.to_json("record"))
    _write_text(records.sparkSession, [head[:-1] + ",", '"records":{', _lines(clean, "code", text), "}}"], path)


def write_missing_report(report: DataFrame, missing: DataFrame, path: str, generated_at: str = "") -> None:
    """The missing report: figures (one row), companies by reason, all of them, and what to do about each reason. Companies are written
    in parallel, a line each."""
    names = {"target_companies": "targetCompanies", "implemented_companies": "implementedCompanies", "missing_companies": "missingCompanies", "ordinary_missing": "ordinaryMissingCompanies", "new_listing": "newListingOrRecentIpo", "separate_model": "separateModelCompanies"}
    figures = {"generatedAt": generated_at} | report.select(*(F.col(c).alias(n) for c, n in names.items())).first().asDict()
    item = F.to_json(F.struct("code", "name", "market", "industry", "reason"))
    present = [r.reason for r in missing.groupBy("reason").agg(F.min("seq").alias("s")).orderBy("s").collect()]  # three at most
    parts: list[DataFrame | str] = [json.dumps(figures, ensure_ascii=False)[:-1] + ',"reasons":{']
    for i, reason in enumerate(present):
        parts += [f'"{reason}":[', _lines(missing.filter(F.col("reason") == reason), "seq", item), "]" + "," * (i + 1 < len(present))]
    parts += ['},"missing":[', _lines(missing, "seq", item), '],"policy":' + json.dumps(rules.POLICIES, ensure_ascii=False) + "}"]
    _write_text(report.sparkSession, parts, path)


def write_report(df: DataFrame, path: str) -> None:
    """A small status row as one JSON file; callers pass aggregates."""
    df.coalesce(1).write.mode("overwrite").json(path)
