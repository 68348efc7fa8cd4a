"""Companies: listing filter, classes, themes, what is missing, coverage."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.scalar import first_match, round2, strip


def any_token(c: Column, tokens: tuple[str, ...]) -> Column:
    """Whether a text contains one of the tokens: one pass with an alternation."""
    return F.coalesce(c.rlike("|".join(tokens)), F.lit(False))


def listed(sheet: DataFrame) -> DataFrame:
    """rows of a listing sheet that are companies, trimmed, without funds; blank market or industry is unknown."""
    df = sheet.withColumns({c: strip(F.coalesce(c, F.lit(""))) for c in ("code", "name", "market", "industry")})
    blank = lambda c: (F.col(c) == "") | (F.lower(c) == "nan")
    df = df.filter(~blank("code") & ~blank("name") & ~any_token(F.col("market"), rules.MARKET_TOKENS) & ~any_token(F.col("name"), rules.LISTING_NAME_TOKENS))
    df = df.filter(F.col("code").rlike(r"^(\d{4}|\d{3}[A-Z]|\d{5})$"))
    return df.withColumns({c: F.when(blank(c), rules.UNKNOWN).otherwise(F.col(c)) for c in ("market", "industry")})


def security_like() -> Column:
    """code, market, industry or name point to a security or a financial company."""
    long_code = (F.length("code") > 4) & ~F.col("code").rlike(r"^\d{3}[A-Z]$")
    parts = [F.coalesce(long_code, F.lit(False)), any_token(F.col("market"), rules.MARKET_TOKENS), F.coalesce(F.col("industry").isin(*rules.SEPARATE_INDUSTRIES), F.lit(False)), any_token(F.col("name"), rules.SECURITY_NAME_TOKENS)]
    return reduce(or_, parts)


def company_class() -> Column:
    """F3."""
    return F.when(security_like(), rules.SEPARATE).when(F.col("code").rlike(r"^\d{3}[A-Z]$"), rules.NEW_LISTING).otherwise(rules.ORDINARY)


def missing(companies: DataFrame, records: DataFrame) -> DataFrame:
    """Companies without a record, with the reason."""
    return companies.join(records.select("code"), "code", "left_anti").withColumn("reason", company_class())


def missing_counts(missing_rows: DataFrame) -> DataFrame:
    """A3: number of missing companies by reason."""
    return missing_rows.groupBy("reason").agg(F.count("*").alias("companies"))


REASONS = ((rules.ORDINARY, "ordinary_missing"), (rules.NEW_LISTING, "new_listing"), (rules.SEPARATE, "separate_model"))


def missing_report(companies: DataFrame, records: DataFrame) -> DataFrame:
    """A3: one row: target, implemented (all records, whether they have a company or not), missing, and missing by reason."""
    gone = missing(companies, records)
    reasons = gone.agg(F.count("*").alias("missing_companies"), *(F.count_if(F.col("reason") == r).alias(n) for r, n in REASONS))
    return companies.agg(F.count("*").alias("target_companies")).crossJoin(records.agg(F.count("*").alias("implemented_companies"))).crossJoin(reasons)  # one row each


def coverage(companies: DataFrame, records: DataFrame) -> DataFrame:
    """A4: the missing report with ratio and message."""
    return with_status(missing_report(companies, records))


def with_status(report: DataFrame, records: Column | None = None) -> DataFrame:
    """Fills in what a report lacks (0 counts as lacking, as does null): implemented from the number of records, missing from target and
    implemented; adds ratio and message."""
    lacks = lambda c: F.nullif(F.col(c), F.lit(0))
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    df = report.withColumns({c: number(c) for c in ("target_companies", *(n for _, n in REASONS))})
    df = df.withColumn("implemented_companies", F.coalesce(lacks("implemented_companies"), F.lit(0) if records is None else records).cast("long"))
    df = df.withColumn("missing_companies", F.coalesce(lacks("missing_companies"), F.greatest(F.col("target_companies") - F.col("implemented_companies"), F.lit(0))).cast("long"))
    df = df.withColumn("coverage_ratio", F.coalesce(round2(F.col("implemented_companies") / lacks("target_companies") * 100), F.lit(0.0)))
    n = lambda c: F.format_number(c, 0)
    text = F.concat(F.lit("JPX上場企業ユニバースを更新し、対象"), n("target_companies"), F.lit("社中"), n("implemented_companies"), F.lit("社を取得済み、未取得"), n("missing_companies"), F.lit("社。普通企業の未取得は"), n("ordinary_missing"), F.lit("社。"))
    return df.withColumn("message", text)


#: Names in a status file of the columns of a report.
STATUS_NAMES = {
    "implemented_companies": "companies", "target_companies": "targetCompanies", "missing_companies": "missingCompanies", "ordinary_missing": "ordinaryMissingCompanies",
    "new_listing": "newListingOrRecentIpo", "separate_model": "separateModelCompanies", "coverage_ratio": "coverageRatio", "message": "message",
}
#: Totals in a status file by the names that a snapshot's statistics have.
STATUS_TOTALS = {"ordinaryFallbackAdded": "ordinaryFallbackAddedTotal", "ordinaryLatestRefreshed": "ordinaryLatestRefreshedTotal", "ordinaryRefreshFailures": "ordinaryRefreshFailuresTotal"}
#: What each status file says.
STATUS_CONSTANTS = {"mode": "jpx-universe-edinet-ordinary-autofill", "status": "ready", "source": "JPX+EDINET+TDnet", "edinetMerged": True}


def status_row(report: DataFrame, records: DataFrame, stats: DataFrame, previous: DataFrame | None = None, generated_at: str | None = None) -> DataFrame:
    """The row of the status file: when it was made (now, in UTC, unless given), the report's figures, totals of the snapshot's
    statistics (one row of s, a map; 0 for what it lacks), fixed values, and what else the previous row holds. tdnetOverlay is kept, and true where
    there was none."""
    made = generated_at if generated_at is not None else datetime.now(timezone.utc).isoformat()
    one = report.crossJoin(records.agg(F.count("*").alias("_records"))).crossJoin(stats.select(F.col("s").alias("_s")))  # one row each
    df = with_status(one, F.col("_records"))
    total = lambda k: F.coalesce(F.try_element_at("_s", F.lit(k)), F.lit(0.0)).cast("long")
    now = df.select(
        F.lit(made).alias("generatedAt"), *(F.lit(v).alias(k) for k, v in STATUS_CONSTANTS.items()), *(F.col(c).alias(n) for c, n in STATUS_NAMES.items()), *(total(k).alias(n) for k, n in STATUS_TOTALS.items())
    )
    if previous is None or "tdnetOverlay" not in previous.columns:
        now = now.withColumn("tdnetOverlay", F.lit(True))
    return now if previous is None else carried(previous, now)


def carried(previous: DataFrame, current: DataFrame) -> DataFrame:
    """The status row with the previous one's other columns carried over (one row each)."""
    old = [c for c in previous.columns if c not in current.columns]
    return current.crossJoin(previous.select(*old)) if old else current


def industry_group() -> Column:
    """By industry first, then by words of the name, else the industry itself."""
    cases = [(F.col("industry") == k, g) for k, g in rules.GROUP_OF_INDUSTRY.items()] + [(F.col("name").rlike(r), g) for g, r in rules.GROUP_OF_NAME.items()]
    return first_match(cases, F.col("industry"))


def group_themes(group: Column) -> Column:
    table = F.create_map(*(x for g, t in rules.THEMES.items() for x in (F.lit(g), F.array(*map(F.lit, t)))))
    return F.coalesce(F.try_element_at(table, group), F.array(*map(F.lit, rules.OTHER_THEMES)))


def themed(companies: DataFrame) -> DataFrame:
    """Two of the group's three themes, from the one that row_index (see numbered) points at."""
    df = companies.withColumn("_all", group_themes(industry_group()))
    at = lambda k: F.element_at("_all", (F.pmod(F.col("row_index") + k, F.size("_all")) + 1).cast("int"))
    return df.withColumn("themes", F.array(at(0), at(1))).drop("_all")


def industry_name(code: Column) -> Column:
    """P20: the name of an industry code; other texts stay."""
    table = F.create_map(*(F.lit(x) for kv in rules.INDUSTRY_NAMES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), code)


def last_of_each_code(companies: DataFrame) -> DataFrame:
    """Of rows with the same code the last one counts."""
    rest = [c for c in companies.columns if c not in ("code", "seq")]
    latest = companies.groupBy("code").agg(F.max_by(F.struct(*rest, "seq"), "seq").alias("r"))
    return latest.select("code", "r.*").select(*companies.columns)


def distinct_industries(companies: DataFrame) -> DataFrame:
    """Industries in Japanese order."""
    return companies.select("industry").distinct().orderBy(F.collate("industry", "ja"))


def distinct_themes(companies: DataFrame) -> DataFrame:
    """All themes of the groups that occur."""
    return companies.select(F.explode(group_themes(industry_group())).alias("theme")).distinct().orderBy(F.collate("theme", "ja"))


def numbered(companies: DataFrame, bits: int = 16) -> DataFrame:
    """row_index, the rows' numbers from 0 along seq, whatever gaps that has.

    Rows are numbered within runs of 2^bits values of seq, which hold as many rows at most; the runs' row counts, one small row each, give where
    each run begins.
    """
    runs = companies.withColumn("_run", F.shiftright("seq", bits))
    inside = runs.withColumn("_n", F.row_number().over(W.partitionBy("_run").orderBy("seq")))
    starts = runs.groupBy("_run").agg(F.count("*").alias("_count"))
    starts = starts.select("_run", F.coalesce(F.sum("_count").over(W.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return inside.join(starts, "_run").withColumn("row_index", F.col("_start") + F.col("_n") - 1).drop("_run", "_start", "_n")
