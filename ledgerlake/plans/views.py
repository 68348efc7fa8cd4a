"""The operators applied to the derived tables: what the registered queries build on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import kpi, rules
from ..operators import facts, filings, records, screen, search
from ..operators.universe import missing, numbered
from ..sources.snapshots import RECORD
from ..sources.store import stored
from . import fixtures
from .fixtures import derived

AS_OF = "2001-08-02"


def metric_facts(spark: SparkSession, sf_dir: str, by_document: bool = True) -> DataFrame:
    """fx_facts with metric names in place of elements, those of a document in one task."""
    metric_of = {t: m for m, tags in rules.METRIC_TAGS.items() for t in tags}
    return fixtures.facts(spark, sf_dir, by_document, metric=metric_of.__getitem__)


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[SparkSession, str], DataFrame], by: str) -> DataFrame:
    """A table that several queries read: written once a session, in buckets of a column, and anew when the given tables change."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer", "nation", "events")]
    return stored(spark, f"{name} {sf_dir}", inputs, lambda: make(spark, sf_dir), by)


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 for every document, written once."""
    return kept(spark, sf_dir, "documents", lambda s, d: kpi.kpi_records(facts.wide_facts(metric_facts(s, d))), "doc_id")


def company_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPIs of the document that each company's record stands for, with the operating margins of the company's documents
    up to then as history, oldest first. Some records come from the second source, have ratios, a trend or a label of their own.

    Documents meet filings once, and one aggregation by company picks the record and gathers the history.
    """
    held = derived(spark, sf_dir, "fx_records").select(F.col("document_id").alias("doc_id"), F.lit(True).alias("held"))
    filed = derived(spark, sf_dir, "fx_filings").filter("day_offset >= 45").join(held, "doc_id", "left")
    docs = document_records(spark, sf_dir)
    kpis = [c for c in docs.columns if c != "doc_id"]
    margin = F.when(F.col("v_operatingMargin").isNotNull(), F.struct((-F.col("day_offset")).alias("d"), "doc_id", F.col("v_operatingMargin").alias("m")))
    of_company = filed.join(docs, "doc_id").groupBy(F.col("company_code").alias("code"), F.col("company_seq").alias("seq")).agg(
        F.max(F.when(F.col("held"), F.struct(*kpis, F.col("submit_ts").alias("filed_at"), "period_end", F.concat(F.lit("u:"), "doc_id").alias("source_url")))).alias("r"), F.array_sort(F.collect_list(margin)).alias("h")
    )
    seq = F.col("seq")
    out = of_company.filter("r is not null").select("code", "seq", "r.*", F.transform(F.when(F.size("h") > 3, F.slice("h", -3, 3)).otherwise(F.col("h")), lambda x: x.m).alias("history"))
    own = {
        "source": F.when(seq % 10 == 3, "TDnet").otherwise("EDINET"), "v_per": F.when(seq % 7 == 1, 10.0 + seq % 30), "v_pbr": F.when(seq % 7 == 1, 1.0 + seq % 3),
        "t_roe": F.when(seq % 5 == 2, F.array(F.lit(1.25), F.lit(2.5), F.col("v_roe"))), "l_operatingMargin": F.when(seq % 6 == 1, "前期差"),
    }
    return out.withColumns(own).drop("seq")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(derived(spark, sf_dir, "fx_companies"))


def joined_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 over tables in buckets of code, which are joined without an exchange."""
    of_code = lambda name, make: kept(spark, sf_dir, name, make, "code")
    return screen.company_view(
        of_code("companies", companies), of_code("records", company_records), *(of_code(f"fx_{n}", lambda s, d, n=n: derived(s, d, f"fx_{n}")) for n in ("quotes", "fundamentals"))
    )


def company_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a table in buckets of code, with folded names (P21), written once."""
    return kept(spark, sf_dir, "view", lambda s, d: screen.with_folded(joined_view(s, d)), "code")


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of the view's names and codes, written once in buckets of gram."""
    return kept(spark, sf_dir, "postings", lambda s, d: search.postings(company_view(s, d)), "gram")


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = filings.dated(derived(spark, sf_dir, "fx_filings").drop("day_offset"), AS_OF)
    return filings.annual_filings(listed, derived(spark, sf_dir, "fx_companies"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 over the derived filings: targets are ordinary companies without a record; documents need a KPI record, and the archive of every
    seventeenth order fails."""
    held = derived(spark, sf_dir, "fx_records")
    targets = missing(derived(spark, sf_dir, "fx_companies"), held).filter(F.col("reason") == rules.ORDINARY).select("code").distinct()
    found = filings.candidates(annual(spark, sf_dir), held, targets).withColumn("failed", F.col("o_orderkey") % 17 == 0)
    whole = document_records(spark, sf_dir).select("doc_id", F.lit(True).alias("whole"))
    return filings.scanned_filings(found.join(whole, "doc_id", "left").filter("failed or whole"))


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark, sf_dir).filter(F.col("policy") != rules.FAILED)


def snapshot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, record) of the snapshot after a run, written once."""
    return kept(spark, sf_dir, "snapshot_records", _records_after, "code")


def _records_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as they were, with accepted filings in their place, through JSON and back."""
    before = derived(spark, sf_dir, "fx_records").withColumn("policy", F.lit(None).cast("string"))
    now = filings.upserted(before, filings.latest_accepted(scanned(spark, sf_dir)))
    periods = derived(spark, sf_dir, "fx_filings").select(F.col("doc_id").alias("document_id"), "period_end")
    made = records.built(now.join(periods, "document_id"), document_records(spark, sf_dir), derived(spark, sf_dir, "fx_companies"))
    return made.select("code", F.from_json(F.to_json("record"), RECORD).alias("record"))
