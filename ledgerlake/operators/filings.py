"""Filings: which are read, which are accepted, and the records that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from .universe import security_like


def annual_filings(filings: DataFrame, companies: DataFrame, lookback: int = rules.LOOKBACK_DAYS, refresh: int = rules.REFRESH_DAYS) -> DataFrame:
    """Annual reports of ordinary companies within the look-back range; code is the start of sec_code."""
    df = filings.filter((F.col("doc_type_code") == rules.ANNUAL_REPORT) & (F.col("day_offset") >= 0) & (F.col("day_offset") < max(lookback, refresh)))
    df = df.withColumn("code", F.substring("sec_code", 1, 4))
    return df.join(companies.filter(~security_like()).select("code").distinct(), "code", "left_semi")


def dated(filings: DataFrame, as_of: Column | str, lookback: int = rules.LOOKBACK_DAYS, refresh: int = rules.REFRESH_DAYS) -> DataFrame:
    """filings with day_offset, the days from fetch_day to as_of, within the look-back range. The range is a filter on fetch_day, which the index
    knows from names of files or folders, so that those of other days aren't opened."""
    day = F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of
    inside = (F.col("fetch_day") <= day) & (F.col("fetch_day") > F.date_sub(day, max(lookback, refresh)))
    return filings.filter(inside).withColumn("day_offset", F.datediff(day, "fetch_day"))


def submitted() -> Column:
    """The text by which filings of a company are compared."""
    return F.coalesce("submit_ts", "submit_date", F.lit(""))


def is_newer() -> Column:
    """no record, or another document that was submitted later than filed_at (or filed_at is empty)."""
    return ~F.col("has_record") | (~F.col("doc_id").eqNullSafe(F.col("document_id")) & _later())


def _later() -> Column:
    held = F.coalesce("filed_at", F.lit(""))
    return (held == "") | (F.col("submit") > held)


def candidates(filings: DataFrame, records: DataFrame, targets: DataFrame, refresh: int = rules.REFRESH_DAYS) -> DataFrame:
    """Filings with the record that their company has and whether it is a missing target; what can't be accepted is
    dropped before any archive is read.

    What is held only gets later, so a filing not later than the record falls away at once, except where the company has a recent filing
    without a submit time: once that is held, any other one counts as later.
    """
    df = filings.withColumn("submit", submitted())
    df = df.join(records.select("code", "document_id", "filed_at", F.lit(True).alias("has_record")), "code", "left")
    df = df.join(targets.select("code", F.lit(True).alias("is_target")), "code", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_record", "is_target")})
    recent = F.col("day_offset") < refresh
    untimed = F.max(recent & F.col("submit_ts").isNull()).over(W.partitionBy("code"))
    return df.withColumn("_untimed", untimed).filter(F.col("is_target") | (recent & (~F.col("has_record") | _later() | F.col("_untimed")))).drop("_untimed")


def scanned_filings(tried: DataFrame, refresh: int = rules.REFRESH_DAYS) -> DataFrame:
    """The filings that a scan from the newest day on takes or fails at, one row each with its policy and place.

    tried holds candidates whose document gave a record, and those whose archive failed (failed is true; none are failed without that column).
    A company's filings are folded in order, at a cost that grows with the square of its acceptances, which the look-back range bounds to a few: a
    missing target takes the first; then, within the refresh range, another document submitted later than the one held is taken. What is held after an
    acceptance is the filing's submit_ts, empty if that is null. A failed one changes nothing, and counts where it would have been taken.
    """
    failed = F.coalesce("failed", F.lit(False)) if "failed" in tried.columns else F.lit(False)
    one = F.struct("day_offset", "day_seq", "doc_id", "submit", "submit_ts", failed.alias("failed"))
    per = tried.groupBy("code").agg(
        F.array_sort(F.collect_list(one)).alias("scan"), F.max("is_target").alias("is_target"), F.max("has_record").alias("has_record"),
        F.first("document_id").alias("document_id"), F.first("filed_at").alias("filed_at"),
    )
    fold = f"""aggregate(scan,
      named_struct('filed', coalesce(filed_at, ''), 'held', document_id, 'has', has_record, 'target', is_target,
                   'out', cast(array() as array<struct<day_offset:int,day_seq:int,doc_id:string,submit:string,submit_ts:string,policy:string>>)),
      (a, f) -> case
        when a.target or (f.day_offset < {refresh} and (not a.has or (not f.doc_id <=> a.held and (a.filed = '' or f.submit > a.filed)))) then
          named_struct('filed', if(f.failed, a.filed, coalesce(f.submit_ts, '')), 'held', if(f.failed, a.held, f.doc_id), 'has', a.has or not f.failed, 'target', a.target and f.failed,
            'out', concat(a.out, array(named_struct('day_offset', cast(f.day_offset as int), 'day_seq', cast(f.day_seq as int), 'doc_id', f.doc_id, 'submit', f.submit, 'submit_ts', f.submit_ts,
              'policy', case when f.failed then '{rules.FAILED}' when a.target then '{rules.ADDED_POLICY}' else '{rules.REFRESHED_POLICY}' end))))
        else a end,
      a -> a.out)"""
    return per.select("code", F.posexplode(F.expr(fold)).alias("nth", "x")).select("code", "nth", "x.*")


def accepted_filings(tried: DataFrame, refresh: int = rules.REFRESH_DAYS) -> DataFrame:
    """The filings that the scan accepts."""
    return scanned_filings(tried, refresh).filter(F.col("policy") != rules.FAILED)


def batch(accepted: DataFrame, size: int | None = rules.BATCH_SIZE) -> DataFrame:
    """The first so many acceptances in scan order (a top-k, not a sort of all); None takes all."""
    return accepted if size is None else accepted.orderBy("day_offset", "day_seq", "code").limit(size)


def cut_off(scanned: DataFrame, size: int | None = rules.BATCH_SIZE) -> DataFrame:
    """W3 for a scan with its failures: what comes up to the size-th acceptance in scan order; None takes all."""
    if size is None:
        return scanned
    order = ("day_offset", "day_seq", "code")
    last = batch(scanned.filter(F.col("policy") != rules.FAILED).select(F.struct(*order).alias("_at"), *order), size).agg(F.max("_at").alias("_last"), F.count("*").alias("_n"))
    both = scanned.crossJoin(F.broadcast(last))  # one row
    return both.filter((F.col("_n") < size) | (F.struct(*order) <= F.col("_last"))).drop("_last", "_n")


def latest_accepted(accepted: DataFrame) -> DataFrame:
    """The acceptance that stands for each company in the end: the last one."""
    last = accepted.filter(F.col("policy") != rules.FAILED).groupBy("code").agg(F.max_by(F.struct("doc_id", "submit_ts", "policy"), "nth").alias("x"))
    return last.select("code", F.col("x.doc_id").alias("document_id"), F.col("x.submit_ts").alias("filed_at"), F.col("x.policy").alias("policy"))


def upserted(records: DataFrame, new: DataFrame) -> DataFrame:
    """Records with those of the same code replaced by new ones."""
    return records.join(new.select("code"), "code", "left_anti").unionByName(new, allowMissingColumns=True)


def counted_run(scanned: DataFrame, records: DataFrame, previous: DataFrame) -> DataFrame:
    """A5 from the records before a run: scanned is evaluated once, as the codes that the run adds to the records are counted from it as well."""
    count = lambda p: F.count_if(F.col("policy") == p)
    of_code = scanned.groupBy("code").agg(count(rules.ADDED_POLICY).alias("a"), count(rules.REFRESHED_POLICY).alias("r"), count(rules.FAILED).alias("f"))
    of_code = of_code.join(records.select("code", F.lit(True).alias("held")).distinct(), "code", "left")
    run = of_code.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "arf"), F.count_if(F.col("held").isNull() & (F.col("a") + F.col("r") > 0)).alias("n"))
    both = run.crossJoin(previous).crossJoin(records.agg(F.count("*").alias("held")))  # one row each
    return both.select((F.col("added") + F.col("a")).alias("added"), (F.col("refreshed") + F.col("r")).alias("refreshed"), (F.col("failures") + F.col("f")).alias("failures"), (F.col("held") + F.col("n")).alias("companies"))


def run_totals(scanned: DataFrame, records_after: DataFrame, previous: DataFrame) -> DataFrame:
    """A5: running totals: the previous row's (added, refreshed, failures) plus this run's, and the number of records."""
    count = lambda p: F.count_if(F.col("policy") == p)
    run = scanned.agg(count(rules.ADDED_POLICY).alias("a"), count(rules.REFRESHED_POLICY).alias("r"), count(rules.FAILED).alias("f"))
    both = run.crossJoin(previous).crossJoin(records_after.agg(F.count("*").alias("companies")))  # one row each
    return both.select((F.col("added") + F.col("a")).alias("added"), (F.col("refreshed") + F.col("r")).alias("refreshed"), (F.col("failures") + F.col("f")).alias("failures"), "companies")
