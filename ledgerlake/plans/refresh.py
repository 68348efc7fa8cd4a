"""The whole run: listing -> what is missing -> filings -> archives -> records -> snapshot -> report and status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..functions import kpi, rules
from ..operators import facts, filings, records, universe
from ..sources import archives, keyed
from ..sources.filings import read_filing_index
from ..sources.listing import read_listing
from ..sources.snapshots import write_missing_report, write_report
from ..sources.store import hadoop_path, new_folder

#: What a snapshot's statistics call the outcomes of a scan.
TOTALS = {"ordinaryFallbackAdded": rules.ADDED_POLICY, "ordinaryLatestRefreshed": rules.REFRESHED_POLICY, "ordinaryRefreshFailures": rules.FAILED}


@dataclass
class Places:
    """Where a run reads and writes: listing sheet, folder of filing indexes, folder of archives, keyed snapshot, missing report and status row."""

    listing: str
    index: str
    archives: str
    snapshot: str
    report: str
    status: str


def observed(df: DataFrame, name: str, **figures) -> tuple[DataFrame, dict]:
    """df written to the shared folder and read again, and figures counted while it was written."""
    seen = Observation(name)
    path = new_folder(df.sparkSession, name)
    df.observe(seen, *(c.alias(n) for n, c in figures.items())).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def wanted_archives(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """doc_id, path and length of the archives of some documents; only names are listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("doc_id"), "path", "length").join(doc_ids.distinct(), "doc_id", "left_semi")


def _status_before(spark: SparkSession, path: str) -> DataFrame | None:
    fs, at = hadoop_path(spark, path)
    return spark.read.json(path) if fs.exists(at) else None


def refresh(spark: SparkSession, at: Places, as_of: str, size: int | None = rules.BATCH_SIZE, generated_at: str | None = None) -> dict:
    """Brings the snapshot up to date and writes report and status; returns the run's figures.

    The archives are opened in one pass, of which the facts are written; counts are taken while tables are written. The snapshot is committed
    before report and status, which describe it, so a run that fails in between is made good by the next one.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sheet = universe.last_of_each_code(universe.listed(read_listing(spark, at.listing)))
    companies, seen = observed(sheet.withColumn("industry", universe.industry_name(F.col("industry"))), "companies", n=F.count("*"))
    state = keyed.manifest(spark, at.snapshot) or {}
    held = keyed.read(spark, at.snapshot)
    heads = records.heads(held)

    targets = universe.missing(companies, heads).filter(F.col("reason") == rules.ORDINARY).select("code")
    listed = filings.dated(read_filing_index(spark, at.index), as_of)
    found, _ = observed(filings.candidates(filings.annual_filings(listed, companies), heads, targets), "candidates", n=F.count("*"))

    raw, read = observed(archives.facts_of(wanted_archives(spark, at.archives, found.select("doc_id")), tasks), "facts", failures=F.count("error"), facts=F.count("value"))
    place = raw.filter("error is null").withColumn("place", F.struct("member_idx", "elem_idx"))
    documents, _ = observed(kpi.kpi_records(facts.wide_facts(place, "place")), "documents", n=F.count("*"))
    failed = raw.filter("error is not null").select("doc_id", F.lit(True).alias("failed"))
    tried = found.join(documents.select("doc_id", F.lit(True).alias("whole")), "doc_id", "left").join(failed, "doc_id", "left").filter("whole or failed")
    scan = filings.cut_off(filings.scanned_filings(tried), size)
    scan, run = observed(scan, "scan", **{n: F.count_if(F.col("policy") == p) for n, p in TOTALS.items()})

    taken = filings.latest_accepted(scan).join(found.select(F.col("doc_id").alias("document_id"), "period_end").distinct(), "document_id")
    before = state.get("stats", {})
    stats = before | {n: before.get(n, 0) + run[n] for n in TOTALS}
    keyed.upsert(records.built(taken, documents, companies), at.snapshot, stats=stats)

    now = keyed.read(spark, at.snapshot).select("code")
    gone, report = universe.missing(companies, now), universe.missing_report(companies, now)
    report, _ = observed(report, "report", n=F.count("*"))
    write_missing_report(report, gone, at.report, generated_at or "")
    figures = spark.createDataFrame([({n: float(v) for n, v in stats.items()},)], "s map<string,double>")
    status, _ = observed(universe.status_row(report, now, figures, _status_before(spark, at.status), generated_at), "status", n=F.count("*"))
    write_report(status, at.status)
    return {"companies": seen["n"], "facts": read["facts"], "failures": read["failures"]} | run
