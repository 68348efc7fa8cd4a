"""The company view, screener, dashboard and comparison."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import kpi, rules
from ..functions.scalar import round1
from .universe import themed

SORTS = {"per-asc": ("v_per", True), "pbr-asc": ("v_pbr", True), "roe-desc": ("v_roe", False), "operatingMargin-desc": ("v_operatingMargin", False)}


def company_view(companies: DataFrame, records: DataFrame, quotes: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Companies with KPIs, scores, warnings; a company without a record keeps its quote and is unavailable.

    companies: with row_index. records: code, and any of the columns of kpi.OPTIONAL. Three left joins on code; all that follows is narrow.
    The tables grow with the companies, so none is sent whole to the driver and every task: see merged.
    """
    rec = kpi.with_optional(records).select("code", *kpi.OPTIONAL, F.lit(True).alias("has_record"))
    fun = fundamentals.select("code", *(F.col(c).alias(f"f_{c}") for c in ("eps", "bps", "forecast_eps")), F.lit(True).alias("has_fundamentals"))
    quo = quotes.select("code", "close", "previous_close", "change_percent", "volume", F.lit(True).alias("has_quote"))
    df = themed(companies).join(merged(rec), "code", "left").join(merged(quo), "code", "left").join(merged(fun), "code", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_record", "has_fundamentals", "has_quote")})
    df = kpi.validated(kpi.with_valuation(df))
    # an unavailable company has no KPI, whatever its quote says
    df = df.withColumns({f"{x}_{k}": F.when(F.col("has_record"), F.col(f"{x}_{k}")) for k in rules.KPIS for x in "vptl"})
    df = kpi.analysed(df.withColumn("history", F.coalesce("history", F.array().cast("array<double>"))))
    known = F.col("has_record")
    empty = F.array().cast("array<string>")
    df = df.withColumns({f"s_{n}": F.when(known, F.col(f"s_{n}")).otherwise(0.0) for n in rules.COMPARED_SCORES})
    df = df.withColumn("strengths", F.when(known, F.col("strengths")).otherwise(empty)).withColumn("warnings", F.when(known, F.col("warnings")).otherwise(empty))
    df = df.withColumn("analysis_comment", F.when(known, F.col("analysis_comment")).otherwise(rules.UNAVAILABLE_COMMENT))
    source = F.when(~known, "unavailable").when(F.col("source") == "TDnet", "TDnet").otherwise("EDINET")
    return df.withColumn("has_warning", F.size("warnings") > 0).withColumn("data_source", source)


def merged(table: DataFrame) -> DataFrame:
    """A table that is joined by merging, never by sending it through the driver: what Spark expects of it is the length of its compressed files, and
    in memory it is twenty times that."""
    return table.hint("merge")


def has_financials() -> Column:
    """F9."""
    return F.col("data_source").isin("EDINET", "TDnet")


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, lower case, single spaces, trimmed. Meant to be computed once and stored."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()))


def with_folded(view: DataFrame) -> DataFrame:
    """The view with name_fold, code_fold and market_fold, to be stored, so that searches fold nothing but their needle."""
    return view.withColumns({f"{c}_fold": folded(F.lower(c) if c == "name" else F.col(c)) for c in ("name", "code", "market")})


def fold_needle(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def matches(query: str, text: Column | str = "name", folded_text: Column | str = "name_fold") -> Column:
    """Contained as it is, or folded; a needle that folds to nothing matches."""
    needle = fold_needle(query)
    text, folded_text = (F.col(c) if isinstance(c, str) else c for c in (text, folded_text))
    return text.contains(query) | folded_text.contains(needle) if needle else F.lit(True)


def screened(view: DataFrame, query: str = "", market: str = "all", industry: str = "all", theme: str = "all", warnings_only: bool = False) -> DataFrame:
    """F8. Name, code and market match as they are or folded; name_fold, code_fold and market_fold are used where the view has them."""
    fold = lambda c: F.col(f"{c}_fold") if f"{c}_fold" in view.columns else folded(c)
    q = query.strip().lower()
    if q:
        view = view.filter(matches(q, F.lower("name"), fold("name")) | matches(q, F.col("code"), fold("code")))
    if market != "all":
        view = view.filter(matches(market, F.col("market"), fold("market")))
    if industry != "all":
        view = view.filter(F.col("industry") == industry)
    if theme != "all":
        view = view.filter(F.array_contains("themes", theme))
    return view.filter("has_warning") if warnings_only else view


def sort_key(order: str = "score-desc") -> list[Column]:
    """Companies without the value come last; KPIs count as they are shown, to one place; ties by seq."""
    if order == "code-asc":
        return [F.regexp_extract("code", r"^\d+", 0).cast("long"), F.regexp_replace("code", r"^\d+", ""), F.col("seq")]
    if order in SORTS:
        name, up = SORTS[order]
        return [F.col(name).isNull(), round1(F.col(name)).asc() if up else round1(F.col(name)).desc(), F.col("seq")]
    return [~has_financials(), F.when(has_financials(), F.col("s_overall")).desc_nulls_last(), F.col("seq")]


def ranked(view: DataFrame, orders: tuple[str, ...] = ("score-desc", "code-asc", *SORTS), top: int = 100) -> DataFrame:
    """W5 for several orders in one pass: the first companies of each, column sort and rank (from 1).

    Each row is dealt once for each order, and tasks keep only their own first rows before the shuffle by order.
    """
    none = F.lit(None).cast("double")
    keys = {n: (F.col(c).isNull(), round1(F.col(c)) if up else -round1(F.col(c)), F.lit("")) for n, (c, up) in SORTS.items()}
    keys["code-asc"] = (F.lit(False), F.regexp_extract("code", r"^\d+", 0).cast("double"), F.regexp_replace("code", r"^\d+", ""))
    keys["score-desc"] = (~has_financials(), F.when(has_financials(), -F.col("s_overall")).otherwise(none), F.lit(""))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("sort"), *(k.alias(x) for k, x in zip(keys[n], ("_last", "_key", "_text"), strict=True))) for n in orders)))
    dealt = view.select("*", each.alias("_k")).select(*view.columns, "_k.*")
    place = F.row_number().over(W.partitionBy("sort").orderBy("_last", F.asc_nulls_last("_key"), "_text", "seq"))
    return dealt.withColumn("rank", place).filter(F.col("rank") <= top).drop("_last", "_key", "_text")


def page(view: DataFrame, number: int, order: str = "score-desc", size: int = rules.PAGE_SIZE) -> DataFrame:
    """A page (from 1) of the sorted companies; Spark keeps only number * size rows of each task."""
    return view.orderBy(*sort_key(order)).offset((number - 1) * size).limit(size)


def page_count(view: DataFrame, size: int = rules.PAGE_SIZE) -> DataFrame:
    return view.agg(F.count("*").alias("companies"), F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("pages"))


def dashboard(view: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """One row: companies with data, with warnings, mean overall score (0 if none), coverage in percent.

    A status row (any of target_companies, companies, coverage_ratio; null for unknown) comes before what is counted here.
    """
    ok = has_financials()
    counted = view.agg(
        F.count("*").alias("target_companies"), F.count_if(ok).alias("companies"), F.count_if(ok & F.col("has_warning")).alias("warning_companies"),
        F.coalesce(F.avg(F.when(ok, F.col("s_overall"))), F.lit(0.0)).alias("mean_overall"),
        F.coalesce(F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)) * 100, F.lit(0.0)).alias("coverage_ratio"),
    )
    if status is None:
        return counted
    given = [c for c in ("target_companies", "companies", "coverage_ratio") if c in status.columns]
    both = counted.crossJoin(status.select(*(F.col(c).alias(f"_{c}") for c in given)))  # one row each
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in counted.columns))


def industry_counts(view: DataFrame, top: int = 12) -> DataFrame:
    """A7."""
    return view.groupBy("industry").agg(F.count("*").alias("companies")).orderBy(F.desc("companies"), "industry").limit(top)


def theme_counts(view: DataFrame, top: int = 8) -> DataFrame:
    """A8."""
    return view.select(F.explode("themes").alias("theme")).groupBy("theme").agg(F.count("*").alias("companies")).orderBy(F.desc("companies"), "theme").limit(top)


def top_scores(view: DataFrame, top: int = 5) -> DataFrame:
    """W7."""
    return view.filter(has_financials()).orderBy(F.desc("s_overall"), "seq").limit(top)


def movers(view: DataFrame, top: int = 3) -> DataFrame:
    """Companies with a quote by the size of their change."""
    return view.filter("has_quote").orderBy(F.abs(F.coalesce("change_percent", F.lit(0.0))).desc(), "seq").limit(top)


def resolved(lists: DataFrame, view: DataFrame) -> DataFrame:
    """Rows of ordered lists(list_id, pos, code) with their company; unknown codes fall away."""
    return lists.join(merged(view), "code")


def valid_lists(lists: DataFrame, view: DataFrame, comparing: bool = False) -> DataFrame:
    """Known codes of saved lists; for comparing those with financials, the first MOST_COMPARED of each list."""
    if not comparing:
        return lists.join(merged(view.select("code")), "code", "left_semi")
    kept = lists.join(merged(view.filter(has_financials()).select("code")), "code", "left_semi")
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("list_id").orderBy("pos"))).filter(F.col("_n") <= rules.MOST_COMPARED).drop("_n")


def compare_candidates(view: DataFrame, chosen: DataFrame) -> DataFrame:
    """Companies with financials that aren't chosen yet."""
    return view.filter(has_financials()).join(merged(chosen.select("code")), "code", "left_anti")


def best_flags(compared: DataFrame, by: str = "list_id") -> DataFrame:
    """b_<name> says that a company has the best available KPI or score of its set; ties are all best."""
    w = W.partitionBy(by)
    flags = {f"b_{k}": F.coalesce(F.col(f"v_{k}") == (F.max if more else F.min)(f"v_{k}").over(w), F.lit(False)) for k, more in rules.COMPARED_KPIS.items()}
    flags |= {f"b_{n}": F.col(f"s_{n}") == F.max(f"s_{n}").over(w) for n in rules.COMPARED_SCORES}
    return compared.select("*", *(c.alias(n) for n, c in flags.items()))


def score_pivot(compared: DataFrame, by: str = "list_id") -> DataFrame:
    """A10: a row for each set and score, a column for each place (series0 ...), scores rounded to whole numbers."""
    place = F.row_number().over(W.partitionBy(by).orderBy("pos")) - 1
    df = compared.withColumn("_place", place)
    long = df.select(by, "_place", F.explode(F.create_map(*(x for n in rules.COMPARED_SCORES for x in (F.lit(n), F.floor(F.col(f"s_{n}") + 0.5))))).alias("metric", "score"))
    out = long.groupBy(by, "metric").pivot("_place", list(range(rules.MOST_COMPARED))).agg(F.max("score"))
    return reduce(lambda d, i: d.withColumnRenamed(str(i), f"series{i}"), range(rules.MOST_COMPARED), out)
