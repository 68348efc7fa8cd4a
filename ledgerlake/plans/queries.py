"""Registered queries over the given tables, each with SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import kpi, rules, scalar
from ..operators import facts, filings, records, screen, search, universe
from ..sources import archives
from ..sources.filings import read_filing_index
from ..sources.listing import read_bundle, read_listing
from ..sources.snapshots import cleaned_text, finite_everywhere, read_market, read_records
from ..sources.store import new_folder
from . import files, fixtures, oracle as o, views
from .fixtures import derived

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(body: str, parts: str = "") -> Callable[[Query], Query]:
    """Registers a query under its name with its SQL: a body over the derived tables and further parts."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = o.over(body, parts)
        return f

    return add


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


LISTS = "lists as (select seq // 7 as list_id, seq * 5 % 7 as pos, case when seq % 11 = 0 then concat('X', code) else code end as code from fx_companies)"


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """Saved lists of seven codes, of which some are unknown."""
    c = derived(spark, sf, "fx_companies")
    code = F.when(F.col("seq") % 11 == 0, F.concat(F.lit("X"), "code")).otherwise(F.col("code"))
    return c.select(F.expr("seq div 7").alias("list_id"), (F.col("seq") * 5 % 7).alias("pos"), code.alias("code"))


# companies -----------------------------------------------------------------------------------------------------------


@query(f"select seq, code, name, market, industry from fx_companies where not {o.tokens('market', rules.MARKET_TOKENS)} and not {o.tokens('name', rules.LISTING_NAME_TOKENS)} and regexp_matches(code, '^(\\d{{4}}|\\d{{3}}[A-Z]|\\d{{5}})$')")
def listing_filter(spark, sf):
    return universe.listed(derived(spark, sf, "fx_companies"))


@query(f"select code, {o.SECURITY} as is_security, {o.CLASS} as class from fx_companies")
def security_class(spark, sf):
    return derived(spark, sf, "fx_companies").select("code", universe.security_like().alias("is_security"), universe.company_class().alias("class"))


@query(f"select code, name, {o.CLASS} as reason from fx_companies where code not in (select code from fx_records)")
def missing_report(spark, sf):
    return universe.missing(derived(spark, sf, "fx_companies"), derived(spark, sf, "fx_records")).select("code", "name", "reason")


@query(f"select {o.CLASS} as reason, count(*) as companies from fx_companies where code not in (select code from fx_records) group by 1")
def missing_counts(spark, sf):
    return universe.missing_counts(universe.missing(derived(spark, sf, "fx_companies"), derived(spark, sf, "fx_records")))


@query(
    f"""select target_companies, implemented_companies, case when m = 0 then greatest(target_companies - implemented_companies, 0) else m end as missing_companies, ordinary_missing, new_listing, separate_model,
  {o.r2('implemented_companies / target_companies * 100')} as coverage_ratio,
  format('JPX上場企業ユニバースを更新し、対象{{:,}}社中{{:,}}社を取得済み、未取得{{:,}}社。普通企業の未取得は{{:,}}社。', target_companies, implemented_companies, case when m = 0 then greatest(target_companies - implemented_companies, 0) else m end, ordinary_missing) as message from s""",
    f"""s as (select (select count(*) from fx_companies) as target_companies, (select count(*) from fx_records) as implemented_companies, count(*) as m,
  count(*) filter (r = '{rules.ORDINARY}') as ordinary_missing, count(*) filter (r = '{rules.NEW_LISTING}') as new_listing, count(*) filter (r = '{rules.SEPARATE}') as separate_model
  from (select {o.CLASS} as r from fx_companies where code not in (select code from fx_records)))""",
)
def coverage_status(spark, sf):
    return universe.coverage(derived(spark, sf, "fx_companies"), derived(spark, sf, "fx_records"))


@query("select code, theme1, theme2 from themed", o.THEMED)
def themes(spark, sf):
    t = universe.themed(views.companies(spark, sf))
    return t.select("code", F.col("themes")[0].alias("theme1"), F.col("themes")[1].alias("theme2"))


@query("select seq, row_number() over (order by seq) - 1 as row_index from fx_companies")
def row_index(spark, sf):
    return universe.numbered(derived(spark, sf, "fx_companies")).select("seq", F.col("row_index").cast("long"))


_CODES = list(rules.INDUSTRY_NAMES)
_NAME_OF = o.case([(f"seq % 40 = {i}", o.text(n)) for i, n in enumerate(rules.INDUSTRY_NAMES.values())], "concat('x', cast(seq as varchar))")


@query(f"select seq, {_NAME_OF} as industry from fx_companies")
def industry_names(spark, sf):
    place = (F.col("seq") % 40).cast("int")
    code = F.coalesce(F.get(F.array(*map(F.lit, _CODES)), place), F.concat(F.lit("x"), F.col("seq").cast("string")))
    return derived(spark, sf, "fx_companies").select("seq", universe.industry_name(code).alias("industry"))


@query("select code, max(seq) as seq, arg_max(name, seq) as name from (select substr(code, 1, 3) as code, seq, name from fx_companies) group by code")
def universe_dedupe(spark, sf):
    c = derived(spark, sf, "fx_companies").withColumn("code", F.substring("code", 1, 3))
    return universe.last_of_each_code(c).select("code", "seq", "name")


@query("select 'industry' as kind, industry as value from fx_companies union select 'theme', unnest(th) from themed", o.THEMED)
def distinct_lists(spark, sf):
    c = derived(spark, sf, "fx_companies")
    industries = universe.distinct_industries(c).select(F.lit("industry").alias("kind"), F.col("industry").alias("value"))
    return industries.union(universe.distinct_themes(c).select(F.lit("theme"), "theme"))


# filings and facts ---------------------------------------------------------------------------------------------------


@query("select code, doc_id, day_offset, day_seq from annual", o.ACCEPTED)
def annual_filings(spark, sf):
    return views.annual(spark, sf).select("code", "doc_id", F.col("day_offset").cast("long"), F.col("day_seq").cast("long"))


@query(
    """select doc_id, count(*) as n_facts, sum(value) as total, count(*) filter (bucket like 'previous%') as n_previous, min(metric) as first_metric from (
  select doc_id, metric, bucket, value from m_facts where seq % 11 <> 0) group by doc_id""",
    o.M_FACTS,
)
def fact_parse(spark, sf):
    f = fixtures.facts(spark, sf, by_document=True)
    year = F.when(F.col("bucket").startswith("current"), "CurrentYear").otherwise("PriorYear")
    kind = F.when(F.col("bucket").endswith("duration"), "Duration").otherwise("Instant")
    raw = f.select("doc_id", F.concat(F.lit("{ns}"), "tag").alias("tag"), F.concat(year, kind, F.lit("_Member")).alias("context_ref"), F.when(F.col("seq") % 11 != 0, F.concat(F.lit("　"), F.format_number("value", 0), F.lit(" "))).otherwise("").alias("text"))
    p = facts.parsed_facts(raw)
    return p.groupBy("doc_id").agg(F.count("*").alias("n_facts"), F.sum("value").alias("total"), F.count_if(F.col("bucket").startswith("previous")).alias("n_previous"), F.min("metric").alias("first_metric"))


@query(f"select doc_id, metric, bucket, case when metric = '{rules.SUMMED_METRIC}' then sum(value) else arg_min(value, seq) end as value from m_facts group by doc_id, metric, bucket", o.M_FACTS)
def fact_pick(spark, sf):
    return facts.picked_facts(views.metric_facts(spark, sf))


_WIDE = ["doc_id", *(f"{m}_{b}" for m in rules.METRIC_TAGS for b in rules.BUCKETS if m != "bps")]


@query(f"select {', '.join(_WIDE)} from wide", o.WIDE)
def fact_wide(spark, sf):
    return facts.wide_facts(views.metric_facts(spark, sf)).select(*_WIDE)


@query(f"select {', '.join(_WIDE)} from wide where doc_id in (select doc_id from annual)", o.WIDE + ", " + o.ACCEPTED.removeprefix(o.DOCS + ", ").split(" target as")[0].rstrip(" ,\n"))
def facts_wanted(spark, sf):
    """A1, A2 for annual reports alone: facts of other documents aren't shuffled."""
    return facts.wide_facts(facts.of_documents(views.metric_facts(spark, sf, by_document=False), views.annual(spark, sf))).select(*_WIDE)


_KPI = [f"{x}_{k}" for k in kpi.RECORD_KPIS for x in "vp"]


@query(f"select doc_id, n_kpis, eps, {', '.join(_KPI)} from docs", o.DOCS)
def kpi_record(spark, sf):
    return views.document_records(spark, sf).select("doc_id", "n_kpis", "eps", *_KPI)


@query("select code, cast(nth as integer) as nth, doc_id, submit_ts, policy from accepted", o.ACCEPTED)
def filing_selection(spark, sf):
    return views.accepted(spark, sf).select("code", "nth", "doc_id", "submit_ts", "policy")


@query(f"select code, doc_id, policy from accepted order by day_offset, day_seq, code limit {rules.BATCH_SIZE}", o.ACCEPTED)
def filing_batch(spark, sf):
    return filings.batch(views.accepted(spark, sf)).select("code", "doc_id", "policy")


@query("select code, document_id, filed_at, policy from last union all select code, document_id, filed_at, null from fx_records where code not in (select code from last)", o.ACCEPTED + ", " + o.LAST)
def upsert_records(spark, sf):
    return filings.upserted(derived(spark, sf, "fx_records"), filings.latest_accepted(views.accepted(spark, sf)))


@query(
    f"""select 415 + count(*) filter (policy = '{rules.ADDED_POLICY}') as added, 1433 + count(*) filter (policy = '{rules.REFRESHED_POLICY}') as refreshed, 12 + count(*) filter (policy = '{rules.FAILED}') as failures,
  (select count(distinct code) from (select code from fx_records union all select code from accepted)) as companies from scanned""",
    o.ACCEPTED,
)
def run_totals(spark, sf):
    return filings.counted_run(views.scanned(spark, sf), derived(spark, sf, "fx_records"), spark.sql("select 415L as added, 1433L as refreshed, 12 as failures"))


_EACH_KPI = (
    "select code, doc_id as document_id, filed_at, period_end, policy, source_url, kpi, value, previous from ("
    + " union all ".join(f"select rcode as code, doc_id, filed_at, period_end, policy, source_url, '{k}' as kpi, v_{k} as value, p_{k} as previous from held where v_{k} is not null" for k in kpi.RECORD_KPIS)
    + ")"
)


@query(_EACH_KPI, o.AFTER)
def record_json(spark, sf):
    """M7: records after a run, from JSON, a row for each KPI."""
    r = views.snapshot_records(spark, sf)
    each = r.select("code", "record", F.explode("record.metrics").alias("kpi", "m"))
    return each.select("code", F.col("record.documentId").alias("document_id"), F.col("record.filedAt").alias("filed_at"), F.col("record.periodEnd").alias("period_end"), F.col("record.quality.policy").alias("policy"), F.col("record.sourceUrl").alias("source_url"), "kpi", "m.value", F.col("m.previousValue").alias("previous"))


_STATUS = ("companies", "targetCompanies", "missingCompanies", "ordinaryMissingCompanies", "newListingOrRecentIpo", "separateModelCompanies", "coverageRatio", "message")


@query(
    f"""select '2001-08-02T00:00:00+00:00' as "generatedAt", 'jpx-universe-edinet-ordinary-autofill' as mode, 'ready' as status, 'JPX+EDINET+TDnet' as source, true as "edinetMerged", false as "tdnetOverlay", 80 as "edinetBatchSize", i as companies, t as "targetCompanies", m as "missingCompanies",
  om as "ordinaryMissingCompanies", nl as "newListingOrRecentIpo", sm as "separateModelCompanies", {o.r2('i / t * 100')} as "coverageRatio", 415 as "ordinaryFallbackAddedTotal", 1433 as "ordinaryLatestRefreshedTotal", 0 as "ordinaryRefreshFailuresTotal",
  format('JPX上場企業ユニバースを更新し、対象{{:,}}社中{{:,}}社を取得済み、未取得{{:,}}社。普通企業の未取得は{{:,}}社。', t, i, m, om) as message from s""",
    f"""s as (select (select count(*) from fx_companies) as t, (select count(*) from fx_records) as i, count(*) as m,
  count(*) filter (r = '{rules.ORDINARY}') as om, count(*) filter (r = '{rules.NEW_LISTING}') as nl, count(*) filter (r = '{rules.SEPARATE}') as sm
  from (select {o.CLASS} as r from fx_companies where code not in (select code from fx_records)))""",
)
def status_row(spark, sf):
    """The status row, with totals from a snapshot's statistics and what the previous row held."""
    c, r = derived(spark, sf, "fx_companies"), derived(spark, sf, "fx_records")
    stats = spark.sql("select map('ordinaryFallbackAdded', 415D, 'ordinaryLatestRefreshed', 1433D) as s")
    before = spark.sql("select 'old' as mode, '2001-08-01' as generatedAt, false as tdnetOverlay, 80 as edinetBatchSize, 1.5D as coverageRatio")
    return universe.status_row(universe.missing_report(c, r), r, stats, before, "2001-08-02T00:00:00+00:00")


# sources, read from files that are written from the tables --------------------------------------------------------------


@query(f"select code, name, market, industry from fx_companies where not {o.tokens('market', rules.MARKET_TOKENS)} and not {o.tokens('name', rules.LISTING_NAME_TOKENS)} and regexp_matches(code, '^(\\d{{4}}|\\d{{3}}[A-Z]|\\d{{5}})$')")
def listing_sheet(spark, sf):
    """The sheet as CSV."""
    return universe.listed(read_listing(spark, files.listing_sheet(spark, sf))).select("code", "name", "market", "industry")


@query("select code, name, market, industry from fx_companies where seq % 9 <> 0")
def text_bundle(spark, sf):
    """Entries of a text bundle; those with an empty field are none."""
    return read_bundle(spark, files.bundle(spark, sf)).select("code", "name", "market", "industry")


@query(f"select doc_id, sec_code, doc_type_code, submit_ts, period_end, cast(day_seq as bigint) as day_seq, cast(day_offset as bigint) as day_offset from fx_filings where day_offset >= 0 and day_offset < {rules.LOOKBACK_DAYS}")
def index_days(spark, sf):
    """The days of the index within the look-back range; others aren't opened."""
    listed = filings.dated(read_filing_index(spark, files.filing_index(spark, sf)), views.AS_OF)
    return listed.select("doc_id", "sec_code", "doc_type_code", "submit_ts", "period_end", F.col("day_seq").cast("long"), F.col("day_offset").cast("long"))


_ARCHIVED = o.ACCEPTED.removeprefix(o.DOCS + ", ").split(" target as")[0].rstrip(" ,\n")


@query(
    """select doc_id, count(metric) as n_facts, sum(value) as total, count(distinct member) as members, count(*) filter (broken) as errors from (
  select a.doc_id, a.o_orderkey % 17 = 0 as broken, case when a.o_orderkey % 17 > 0 then metric end as metric, case when a.o_orderkey % 17 > 0 then value end as value, case when a.o_orderkey % 17 > 0 then seq % 4 end as member
  from annual a join m_facts f on a.doc_id = f.doc_id where a.fetch_day > date '2000-08-01' and (seq % 4 < 3 or a.o_orderkey % 17 = 0)
  qualify a.o_orderkey % 17 > 0 or row_number() over (partition by a.doc_id order by seq) = 1) group by doc_id""",
    o.M_FACTS + ", " + _ARCHIVED,
)
def archive_facts(spark, sf):
    """Facts of the first three members of each archive of a year, by the data source; archives that are cut off give an error."""
    facts_ = archives.archive_facts(spark, files.archives(spark, sf)).filter(F.col("fetch_day") > F.lit("2000-08-01").cast("date"))
    return facts_.groupBy("doc_id").agg(F.count("metric").alias("n_facts"), F.sum("value").alias("total"), F.countDistinct("member_idx").alias("members"), F.count("error").alias("errors"))


@query(_EACH_KPI, o.AFTER)
def record_ranges(spark, sf):
    """The records of a snapshot that is one file, read in ranges of bytes."""
    r = read_records(spark, files.snapshot(spark, sf), step=1 << 16)
    each = r.select("code", "record", F.explode("record.metrics").alias("kpi", "m"))
    return each.select("code", F.col("record.documentId").alias("document_id"), F.col("record.filedAt").alias("filed_at"), F.col("record.periodEnd").alias("period_end"), F.col("record.quality.policy").alias("policy"), F.col("record.sourceUrl").alias("source_url"), "kpi", "m.value", F.col("m.previousValue").alias("previous"))


@query("select coalesce(q.code, f.code) as code, close, previous_close, change_percent, volume, eps, bps, forecast_eps from fx_quotes q full join fx_fundamentals f on q.code = f.code")
def market_snapshot(spark, sf):
    """Quotes and fundamentals of a snapshot whose first source is cut off."""
    q, f = read_market(spark, *files.market(spark, sf), step=1 << 14)
    q = q.select("code", "close", F.col("previousClose").alias("previous_close"), F.col("changePercent").alias("change_percent"), "volume")
    return q.join(f.withColumnRenamed("forecastEps", "forecast_eps"), "code", "full")


# KPIs of companies ---------------------------------------------------------------------------------------------------


@query("select code, v_per, p_per, v_pbr, p_pbr from view where has_record", o.VIEW)
def valuation_kpis(spark, sf):
    return views.company_view(spark, sf).filter("has_record").select("code", "v_per", "p_per", "v_pbr", "p_pbr")


def _cells_sql() -> str:
    rows = []
    for k, (unit, _) in rules.KPIS.items():
        normal, good, more = rules.STATUS[k]
        sign = ">=" if more else "<="
        s = o.case([(f"v_{k} is null", "'unknown'"), (f"v_{k} {sign} {good}", "'good'"), (f"v_{k} {sign} {normal}", "'normal'")], "'warning'")
        t = o.case([(f"status = '{n}'", o.text(c)) for n, c in zip(("good", "normal", "warning"), rules.COMMENTS[k], strict=True)], o.text(rules.NO_DATA_COMMENT))
        fresh = f"case when fresh_{k} then {o.text(rules.DAY_LABEL)} else {o.text(rules.YEAR_LABEL)} end" if k in ("per", "pbr") else f"case when own_label then '前期差' else {o.text(rules.YEAR_LABEL)} end" if k == "operatingMargin" else o.text(rules.YEAR_LABEL)
        label = f"case when v_{k} is not null then {fresh} end"
        pair, own = f"v_{k} is not null and p_{k} is not null", f"v_{k} is not null and own_trend" if k == "roe" else "false"
        n, first = f"case when {own} then 3 when {pair} then 2 else 0 end", f"case when {own} then 1.3 when {pair} then {o.r1(f'p_{k}')} end"
        rows.append(f"select code, '{k}' as kpi, coalesce({o.r1(f'v_{k}')}, 0) as value, case when v_{k} is not null then {o.r1(f'p_{k}')} end as previous_value, {o.text(unit)} as unit, status, {t} as comment, {label} as label, {n} as n_trend, {first} as trend_first from (select *, {s} as status from view)")
    return " union all ".join(rows)


@query(_cells_sql(), o.VIEW)
def kpi_cells(spark, sf):
    view = views.company_view(spark, sf)
    cells = view.select("code", F.explode(F.array(*(F.struct(F.lit(k).alias("kpi"), kpi.cell(k).alias("c")) for k in rules.KPIS))).alias("x"))
    return cells.select("code", "x.kpi", "x.c.value", F.col("x.c.previousValue").alias("previous_value"), "x.c.unit", "x.c.status", "x.c.comment", F.col("x.c.comparisonLabel").alias("label"), F.size("x.c.trend").alias("n_trend"), F.get("x.c.trend", F.lit(0)).alias("trend_first"))


_SCORES = [f"s_{n}" for n in rules.SCORES]


@query(f"select code, {', '.join(_SCORES)} from view", o.VIEW)
def category_scores(spark, sf):
    return views.company_view(spark, sf).select("code", *_SCORES)


@query("select code, s_overall, case when s_overall >= 80 then 'Excellent' when s_overall >= 65 then 'Strong' when s_overall >= 50 then 'Neutral' else 'Watch' end as rating, case when not has_record then 'unknown' when s_overall >= 70 then 'high' when s_overall >= 50 then 'mid' else 'low' end as band from view", o.VIEW)
def overall_score(spark, sf):
    s = F.col("s_overall")
    return views.company_view(spark, sf).select("code", "s_overall", scalar.rating(s).alias("rating"), scalar.band(s, F.col("has_record")).alias("band"))


@query("select code, warnings, has_warning from view", o.VIEW)
def warnings(spark, sf):
    return views.company_view(spark, sf).select("code", joined("warnings"), "has_warning")


@query("select code, strengths from view", o.VIEW)
def strengths(spark, sf):
    return views.company_view(spark, sf).select("code", joined("strengths"))


@query("select code, analysis_comment from view", o.VIEW)
def analysis_comment(spark, sf):
    return views.company_view(spark, sf).select("code", "analysis_comment")


_VIEW = ["code", "name", "industry", "data_source", "live_kpis", "s_overall", "close", "change_percent", "volume", "has_quote", "has_warning", "filed_at", "period_end", "source_url"]


@query(f"select {', '.join(_VIEW)} from view", o.VIEW)
def company_view(spark, sf):
    return views.company_view(spark, sf).select(*_VIEW)


@query(f"select {', '.join(_VIEW)}, v_per, v_pbr, warnings from view", o.VIEW_AFTER)
def view_from_snapshot(spark, sf):
    """J4 over the records of the snapshot that a run leaves."""
    view = screen.company_view(views.companies(spark, sf), records.flat(views.snapshot_records(spark, sf)), derived(spark, sf, "fx_quotes"), derived(spark, sf, "fx_fundamentals"))
    return view.select(*_VIEW, "v_per", "v_pbr", joined("warnings"))


# screener, dashboard, comparison -------------------------------------------------------------------------------------


@query("select code, name, market from fx_companies where contains(lower(replace(replace(concat(name, ' ', market), '（', '('), '）', ')')), '1 プライム(内国')")
def search_fold(spark, sf):
    c = derived(spark, sf, "fx_companies").withColumn("both", F.concat("name", F.lit(" "), "market"))
    return c.withColumn("name_fold", screen.folded("both")).filter(screen.matches("1　ﾌﾟﾗｲﾑ（内国", "both")).select("code", "name", "market")


@query("select code, name from view where (contains(lower(name), 'customer#00') or contains(code, 'customer#00')) and contains(market, 'プライム') and (theme1 = '資本効率' or theme2 = '資本効率') and has_warning", o.VIEW)
def screen_filter(spark, sf):
    return screen.screened(views.company_view(spark, sf), " Customer#00", "プライム", theme="資本効率", warnings_only=True).select("code", "name")


@query("select code, name from fx_companies where contains(lower(code), '7a') or contains(lower(name), '7a')")
def screen_codes(spark, sf):
    """F8: codes with letters, found in either case and width."""
    c = derived(spark, sf, "fx_companies").withColumn("has_warning", F.lit(False))
    return screen.screened(c, "７a").select("code", "name")


NEEDLES = ("9", "#0", "7A", "tomer#00", "ＣＵＳＴＯＭＥＲ#0000", "１３", "er#00 ", "zzz")
_FOLDED = ("9", "#0", "7a", "tomer#00", "customer#0000", "13", "er#00", "zzz")


@query(" union all ".join(f"select {o.text(n)} as needle, code, name from view where contains(lower(name), '{f}') or contains(lower(code), '{f}')" for n, f in zip(NEEDLES, _FOLDED, strict=True)), o.VIEW)
def search_index(spark, sf):
    """Needles of one letter and more, found by postings of their grams."""
    view, index = views.company_view(spark, sf), views.search_index(spark, sf)
    each = [search.searched(view, index, n).select(F.lit(n).alias("needle"), "code", "name") for n in NEEDLES]
    return reduce(DataFrame.union, each)


_ORDERS = {
    "code-asc": "cast(regexp_extract(code, '^\\d+') as bigint), regexp_replace(code, '^\\d+', ''), seq",
    "score-desc": "case when has_record then 0 else 1 end, case when has_record then s_overall end desc nulls last, seq",
    "per-asc": f"v_per is null, {o.r1('v_per')}, seq",
    "pbr-asc": f"v_pbr is null, {o.r1('v_pbr')}, seq",
    "roe-desc": f"v_roe is null, {o.r1('v_roe')} desc, seq",
    "operatingMargin-desc": f"v_operatingMargin is null, {o.r1('v_operatingMargin')} desc, seq",
}


@query(" union all ".join(f"select '{n}' as sort, code, rank from (select code, row_number() over (order by {k}) as rank from view) where rank <= 100" for n, k in _ORDERS.items()), o.VIEW)
def screen_sorted(spark, sf):
    """The first 100 of each order."""
    view = views.company_view(spark, sf).select("code", "seq", "data_source", "s_overall", *(c for c, _ in screen.SORTS.values()))
    return screen.ranked(view).select("sort", "code", F.col("rank").cast("long"))


@query(f"select code, s_overall from (select *, row_number() over (order by {_ORDERS['score-desc']}) as rn from view) where rn between 31 and 60", o.VIEW)
def screen_page(spark, sf):
    return screen.page(views.company_view(spark, sf), 2).select("code", "s_overall")


_PAGES = (1, 3, 17, 40)


@query(
    " union all ".join(f"select '{n}' as sort, {p} as page, rn - 1 as place, code from (select code, row_number() over (order by {_ORDERS[n]}) as rn from view) where rn between {30 * (p - 1) + 1} and {30 * p}" for n in ("score-desc", "code-asc") for p in _PAGES),
    o.VIEW,
)
def deep_pages(spark, sf):
    """Pages near and far of two orders, each read from the ranges that hold it."""
    out = []
    for order in ("score-desc", "code-asc"):
        index = search.page_index(views.company_view(spark, sf).select("seq", "code", "data_source", "s_overall"), new_folder(spark, "pages"), order)
        out += [search.indexed_page(index, p).select(F.lit(order).alias("sort"), F.lit(p).alias("page"), "place", "code") for p in _PAGES]
    return reduce(DataFrame.union, out)


@query("select count(*) as companies, greatest(1, cast(ceil(count(*) / 30) as bigint)) as pages from view where has_warning", o.VIEW)
def page_count(spark, sf):
    return screen.page_count(views.company_view(spark, sf).filter("has_warning"))


@query("select list_id, pos, l.code, name, data_source from lists l join view v on v.code = l.code", o.VIEW + ", " + LISTS)
def watchlist(spark, sf):
    view = views.company_view(spark, sf)
    saved = screen.valid_lists(lists(spark, sf), view)
    return screen.resolved(saved, view).select("list_id", "pos", "code", "name", "data_source")


_COMPARED = LISTS + f", compared as (select * from (select l.list_id, l.pos, v.*, row_number() over (partition by list_id order by pos) as n from lists l join view v on v.code = l.code where has_record) where n <= {rules.MOST_COMPARED})"


@query("select code, name from view where has_record and code not in (select code from lists where pos = 0)", o.VIEW + ", " + LISTS)
def compare_candidates(spark, sf):
    view = views.company_view(spark, sf)
    return screen.compare_candidates(view, lists(spark, sf).filter("pos = 0")).select("code", "name")


def _compared(spark, sf) -> DataFrame:
    view = views.company_view(spark, sf)
    return screen.resolved(screen.valid_lists(lists(spark, sf), view, comparing=True), view)


_BEST = [f"coalesce(v_{k} = {'max' if more else 'min'}(v_{k}) over (partition by list_id), false) as b_{k}" for k, more in rules.COMPARED_KPIS.items()] + [f"s_{n} = max(s_{n}) over (partition by list_id) as b_{n}" for n in rules.COMPARED_SCORES]
_FLAGS = [f"b_{n}" for n in (*rules.COMPARED_KPIS, *rules.COMPARED_SCORES)]


@query(f"select list_id, code, {', '.join(_BEST)} from compared", o.VIEW + ", " + _COMPARED)
def compare_best(spark, sf):
    return screen.best_flags(_compared(spark, sf)).select("list_id", "code", *_FLAGS)


@query(
    " union all ".join(f"select list_id, '{n}' as metric, {', '.join(f'max(floor(s_{n} + 0.5)) filter (n = {i + 1}) as series{i}' for i in range(rules.MOST_COMPARED))} from compared group by list_id" for n in rules.COMPARED_SCORES),
    o.VIEW + ", " + _COMPARED,
)
def compare_pivot(spark, sf):
    out = screen.score_pivot(_compared(spark, sf))
    return out.select("list_id", "metric", *(F.col(f"series{i}").cast("double") for i in range(rules.MOST_COMPARED)))


@query("select count(*) as target_companies, count(*) filter (has_record) as companies, count(*) filter (has_record and has_warning) as warning_companies, floor(coalesce(avg(s_overall) filter (has_record), 0) * 1e6 + 0.5) / 1e6 as mean_overall, count(*) filter (has_record) / count(*) * 100 as coverage_ratio from view", o.VIEW)
def dashboard_summary(spark, sf):
    """The mean to six places, as sums of doubles depend on their order."""
    return screen.dashboard(views.company_view(spark, sf)).withColumn("mean_overall", F.floor(F.col("mean_overall") * 1e6 + 0.5) / 1e6)


@query("select industry, count(*) as companies from fx_companies group by industry order by companies desc, industry limit 12")
def industry_top12(spark, sf):
    return screen.industry_counts(derived(spark, sf, "fx_companies"))


@query("select theme, count(*) as companies from (select theme1 as theme from themed union all select theme2 from themed) group by theme order by companies desc, theme limit 8", o.THEMED)
def theme_top8(spark, sf):
    return screen.theme_counts(universe.themed(views.companies(spark, sf)))


@query("select code, name, s_overall from view where has_record order by s_overall desc, seq limit 5", o.VIEW)
def top_scores(spark, sf):
    return screen.top_scores(views.company_view(spark, sf)).select("code", "name", "s_overall")


@query("select code, close, change_percent from view where has_quote order by abs(coalesce(change_percent, 0)) desc, seq limit 3", o.VIEW)
def movers(spark, sf):
    return screen.movers(views.company_view(spark, sf)).select("code", "close", "change_percent")


def _tidy(x: str, places: int) -> str:
    return f"regexp_replace(format('{{:,.{places}f}}', floor(({x}) * {10**places} + 0.5) / {10**places}), '\\.?0+$', '')" if places else f"format('{{:,.0f}}', floor(({x}) + 0.5))"


@query(
    f"""select e.event_id, coalesce(case when value > 0 then '+' else '' end || {_tidy('value', 1)} || '億円', '—') as money,
  case when value - 40 > 0 then '+' else '' end || {_tidy('value - 40', 1)} || 'pt' as delta, case when value - 40 > 0 then '+' else '' end || {_tidy('value - 40', 2)} || '%' as percent,
  case when value * 3e6 >= 1e8 then {_tidy('value * 3e6 / 1e8', 1)} || '億株' when value * 3e6 >= 1e4 then {_tidy('value * 3e6 / 1e4', 1)} || '万株' else {_tidy('value * 3e6', 0)} || '株' end as volume,
  case when value - 40 > 0.05 then 'up' when value - 40 < -0.05 then 'down' else 'flat' end as direction,
  '￥' || case when value * 2.5 < 100 then {_tidy('value * 2.5', 1)} else {_tidy('value * 2.5', 0)} end as yen from events e"""
)
def display_text(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    v, d = F.col("value"), F.col("value") - 40
    return e.select("event_id", scalar.value_text(v, "億円").alias("money"), scalar.delta_text(v, F.lit(40.0), "%").alias("delta"), scalar.percent_text(d).alias("percent"), scalar.volume_text(v * 3e6).alias("volume"), scalar.direction(d).alias("direction"), scalar.yen_text(v * 2.5).alias("yen"))


@query("select event_id, case when event_id % 5 <= 2 then null else value end as a, case when event_id % 7 = 0 then null else value end as b from events")
def clean_nonfinite(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    token = F.get(F.array(F.lit("NaN"), F.lit("Infinity"), F.lit("-Infinity")), (F.col("event_id") % 5).cast("int"))
    text = F.concat(F.lit('{"a": '), F.coalesce(token, F.col("value").cast("string")), F.lit("}"))
    parsed = e.select("event_id", F.from_json(cleaned_text(text), "a double").alias("s"), F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("b"))
    return finite_everywhere(parsed.select("event_id", "s.a", "b"))
