"""KPI columns of a company: v_<kpi> and p_<kpi> hold value and previous value, null where a KPI is absent."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, functions as F

from . import rules
from .scalar import clamp, finite, first_match, growth, pct, round1, round2, scale

C = F.col


def v(kpi: str) -> Column:
    return C(f"v_{kpi}")


def p(kpi: str) -> Column:
    return C(f"p_{kpi}")


def record_columns() -> dict[str, Column]:
    """KPIs from the picked facts of a document, columns <metric>_<bucket>; eps and bps to two places."""
    cd, ci, pd, pi = (lambda b: lambda m: C(f"{m}_{b}"))("current_duration"), *((lambda b: lambda m: C(f"{m}_{b}"))(b) for b in ("current_instant", "previous_duration", "previous_instant"))
    none = F.lit(None).cast("double")
    debt, cash = ci("interestBearingDebt"), ci("cash")
    pairs = {
        "revenueGrowth": (growth(cd("revenue"), pd("revenue")), none),
        "operatingMargin": (pct(cd("operatingIncome"), cd("revenue")), pct(pd("operatingIncome"), pd("revenue"))),
        "netMargin": (pct(cd("netIncome"), cd("revenue")), pct(pd("netIncome"), pd("revenue"))),
        "roe": (pct(cd("netIncome"), ci("equity")), pct(pd("netIncome"), pi("equity"))),
        "equityRatio": (pct(ci("equity"), ci("totalAssets")), pct(pi("equity"), pi("totalAssets"))),
        "operatingCfMargin": (pct(cd("operatingCashFlow"), cd("revenue")), pct(pd("operatingCashFlow"), pd("revenue"))),
        "debtRatio": (round2(debt / F.nullif(ci("equity"), F.lit(0.0))), none),
        "netCash": (F.when(cash.isNotNull() | debt.isNotNull(), round2((F.coalesce(cash, F.lit(0.0)) - F.coalesce(debt, F.lit(0.0))) / 1e8)), none),
        "inventoryGrowth": (growth(ci("inventories"), pi("inventories")), none),
        "receivablesGrowth": (growth(ci("receivables"), pi("receivables")), none),
    }
    out = {}
    for k, (now, before) in pairs.items():
        out[f"v_{k}"] = now
        out[f"p_{k}"] = F.when(now.isNotNull(), before)
    return out | {"eps": round2(cd("eps")), "bps": round2(ci("bps"))}


RECORD_KPIS = tuple(k for k in rules.KPIS if k not in ("per", "pbr"))


def kpi_records(wide: DataFrame) -> DataFrame:
    """One row a document with its KPIs; documents with fewer than LEAST_KPIS are dropped."""
    out = wide.select("doc_id", *(c.alias(n) for n, c in record_columns().items()))
    count = reduce(add, (v(k).isNotNull().cast("int") for k in RECORD_KPIS))
    return out.withColumn("n_kpis", count).filter(C("n_kpis") >= rules.LEAST_KPIS)


def usable_previous(close: Column, previous: Column) -> Column:
    """F10."""
    return F.coalesce((close > 0) & (previous > 0) & (F.abs(close / F.nullif(previous, F.lit(0.0)) - 1) <= 0.35), F.lit(False))


def with_valuation(df: DataFrame) -> DataFrame:
    """Per and pbr with previous value, trend and label from close, previous_close, and forecast_eps, eps and bps of f_ (the fundamentals
    row, used as a whole where has_fundamentals) or of the record. Where they can't be had, the record's own stay."""
    chosen = lambda c: F.when(C("has_fundamentals"), C(f"f_{c}")).otherwise(C(c))
    forecast, eps, bps = chosen("forecast_eps"), chosen("eps"), chosen("bps")
    eps = F.when(forecast > 0, forecast).otherwise(eps)
    ok = usable_previous(C("close"), C("previous_close"))
    for k, d in (("per", eps), ("pbr", bps)):
        now, before = C("close") / F.when(d > 0, d), C("previous_close") / F.when(d > 0, d)
        fresh = {"v": now, "p": F.when(ok, before), "t": F.when(ok, F.array(before, now)), "l": F.lit(rules.DAY_LABEL)}
        df = df.withColumns({f"{x}_{k}": F.when(now.isNotNull(), c).otherwise(C(f"{x}_{k}")) for x, c in fresh.items()})
    return df


#: What a record may hold besides KPI values and previous values, null where it doesn't.
OPTIONAL = (
    {f"{x}_{k}": "double" for k in rules.KPIS for x in "vp"} | {f"t_{k}": "array<double>" for k in rules.KPIS} | {f"l_{k}": "string" for k in rules.KPIS}
    | {"eps": "double", "bps": "double", "forecast_eps": "double", "history": "array<double>", "source": "string", "filed_at": "string", "period_end": "string", "source_url": "string"}
)


def with_optional(records: DataFrame) -> DataFrame:
    """Records with a column for everything that a record may hold."""
    return records.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in records.columns})


def valid(kpi: str, x: Column) -> Column:
    """the value, or null where it can't be right."""
    x = finite(x)
    if kpi in ("revenueGrowth", "inventoryGrowth", "receivablesGrowth"):
        return F.when(x >= -100, x)
    if kpi == "debtRatio":
        return F.when(x >= 0, x)
    return F.when((x >= -100) & (x <= 100), x) if kpi == "equityRatio" else x


def validated(df: DataFrame) -> DataFrame:
    """Absent instead of invalid, for all KPIs."""
    return df.withColumns({f"v_{k}": valid(k, v(k)) for k in rules.KPIS})


def status(kpi: str) -> Column:
    """P9."""
    normal, good, more = rules.STATUS[kpi]
    x = v(kpi)
    ok = (lambda t: x >= t) if more else (lambda t: x <= t)
    return F.when(x.isNull(), "unknown").when(ok(good), "good").when(ok(normal), "normal").otherwise("warning")


def cell(kpi: str) -> Column:
    """P10: the KPI as a struct, rounded for display, from v_, p_, t_ and l_ columns. A given trend of two values and more is shown, else the
    previous and the present value where both are known."""
    texts = dict(zip(("good", "normal", "warning"), rules.COMMENTS[kpi], strict=True)) | {"unknown": rules.NO_DATA_COMMENT}
    s = status(kpi)
    before = F.when(v(kpi).isNotNull(), round1(finite(p(kpi))))
    given, none = C(f"t_{kpi}"), F.array().cast("array<double>")
    pair = F.when(before.isNotNull(), F.array(before, round1(v(kpi)))).otherwise(none)
    trend = F.when(v(kpi).isNull(), none).when(F.size(given) >= 2, F.transform(given, round1)).otherwise(pair)
    return F.struct(
        F.coalesce(round1(v(kpi)), F.lit(0.0)).alias("value"),
        before.alias("previousValue"),
        F.when(v(kpi).isNotNull(), F.coalesce(C(f"l_{kpi}"), F.lit(rules.YEAR_LABEL))).alias("comparisonLabel"),
        F.lit(rules.KPIS[kpi][0]).alias("unit"),
        s.alias("status"),
        first_match([(s == n, t) for n, t in texts.items()]).alias("comment"),
        trend.alias("trend"),
        v(kpi).isNotNull().alias("available"),
    )


def live_count() -> Column:
    """P24."""
    return reduce(add, (v(k).isNotNull().cast("int") for k in rules.KPIS))


def filled(kpi: str) -> Column:
    return F.coalesce(v(kpi), F.lit(rules.KPIS[kpi][1]))


def category_scores() -> dict[str, Column]:
    """The five scores, defaults in place of absent KPIs."""
    out = {}
    for name, terms in rules.SCORES.items():
        parts = []
        for weight, kpis, low, high in terms:
            x = filled(kpis[0]) - filled(kpis[1]) if len(kpis) > 1 and kpis[1] else filled(kpis[0])
            s = scale(x, low, high)
            parts.append((F.lit(100.0) - s if len(kpis) > 1 and kpis[1] is None else s) * weight)
        out[name] = clamp(reduce(add, parts))
    return out


def overall() -> Column:
    """From score columns s_<name>; weights of scores without any of their KPIs fall away."""
    has = {n: reduce(or_, (v(k).isNotNull() for k in kpis)) for n, (_, kpis) in rules.OVERALL.items()}
    total = reduce(add, (F.when(has[n], w).otherwise(0.0) for n, (w, _) in rules.OVERALL.items()))
    points = reduce(add, (F.when(has[n], C(f"s_{n}") * w).otherwise(0.0) for n, (w, _) in rules.OVERALL.items()))
    return F.coalesce(points / F.nullif(total, F.lit(0.0)), F.lit(rules.NEUTRAL))


def with_scores(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"s_{n}": c for n, c in category_scores().items()})
    known = v("per").isNotNull() | v("pbr").isNotNull()
    return df.withColumn("s_overall", overall()).withColumn("s_valuation", F.when(known, C("s_valuation")).otherwise(rules.NEUTRAL))


def previous_margin() -> Column:
    """The KPI's previous value, the second last of the history (array of margins), or the present value."""
    return F.coalesce(p("operatingMargin"), F.when(F.size("history") >= 2, F.try_element_at("history", F.lit(-2))), filled("operatingMargin"))


def warnings() -> Column:
    """Texts of the rules that hold, in order; a rule with an absent KPI doesn't. Uses prev_margin and history."""
    h = lambda i: F.get("history", F.lit(i))
    holds = [
        (v("revenueGrowth") > 3) & (v("operatingMargin") < C("prev_margin") - 0.8),
        (v("netMargin") > 0) & (v("operatingCfMargin") < v("netMargin") * 0.55),
        v("inventoryGrowth") > v("revenueGrowth") + 8,
        v("receivablesGrowth") > v("revenueGrowth") + 8,
        v("equityRatio") < 25,
        v("debtRatio") > 2.5,
        v("per").isNotNull() & v("pbr").isNotNull() & ((v("per") > 50) | (v("pbr") > 6)),
        (v("roe") > 18) & (v("equityRatio") < 30),
        (F.size("history") >= 3) & (h(0) > h(1)) & (h(1) > h(2)),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), t) for c, t in zip(holds, rules.WARNINGS, strict=True))), lambda x: x.isNotNull())


def strengths() -> Column:
    """At most four texts, or the one for none."""
    holds = [v("revenueGrowth") >= 10, v("operatingMargin") >= 15, v("roe") >= 14, v("equityRatio") >= 55, v("operatingCfMargin") >= 12, v("netCash") >= 200, (v("per") <= 13) & (v("pbr") <= 1.5)]
    found = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), t) for c, t in zip(holds, rules.STRENGTHS, strict=True))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.slice(found, 1, rules.MOST_STRENGTHS)).otherwise(F.array(F.lit(rules.NO_STRENGTH)))


def analysis_comment() -> Column:
    """P17, from warnings, prev_margin and live_kpis."""
    better = (v("operatingMargin") > C("prev_margin")) & (v("operatingCfMargin") >= 10)
    cases = [(F.coalesce(better, F.lit(False)), rules.IMPROVING_COMMENT)]
    cases += [(F.exists("warnings", (lambda t: lambda w: w.contains(t))(t)), text) for t, text in rules.WARNING_COMMENTS.items()]
    return first_match([*cases, (C("live_kpis") < 6, rules.FEW_KPIS_COMMENT)], rules.DEFAULT_COMMENT)


def analysed(df: DataFrame) -> DataFrame:
    """Scores, warnings, strengths and comment of rows with validated KPIs and a history (array of margins)."""
    df = with_scores(df.withColumn("live_kpis", live_count()).withColumn("prev_margin", previous_margin()))
    return df.withColumn("warnings", warnings()).withColumn("strengths", strengths()).withColumn("analysis_comment", analysis_comment()).withColumn("has_warning", F.size("warnings") > 0)
