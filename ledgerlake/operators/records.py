"""KPI records as the snapshot holds them (M7), and back to flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import kpi, rules
from ..sources.snapshots import METRIC, RECORD


def _metrics() -> Column:
    """The KPIs that a row has, by name."""
    entry = lambda k: F.struct(F.lit(k).alias("key"), F.struct(kpi.v(k).alias("value"), kpi.p(k).alias("previousValue"), F.col(f"t_{k}").alias("trend"), F.col(f"l_{k}").alias("comparisonLabel")).alias("value"))
    found = F.filter(F.array(*(F.when(kpi.v(k).isNotNull(), entry(k)) for k in rules.KPIS)), lambda e: e.isNotNull())
    return F.map_from_entries(found).cast(f"map<string,{METRIC}>")


def built(accepted: DataFrame, documents: DataFrame, companies: DataFrame) -> DataFrame:
    """Code and record of accepted filings (code, document_id, filed_at, period_end, policy) from their documents' KPIs.

    documents: doc_id, KPI columns, eps, bps. Filings are few beside documents, so the join with documents is on what is left of them.
    """
    names = companies.groupBy("code").agg(F.max_by("name", "seq").alias("name"))
    df = accepted.join(kpi.with_optional(documents.drop("filed_at", "period_end")).withColumnRenamed("doc_id", "document_id").drop("filed_at", "period_end"), "document_id").join(names, "code", "left")
    record = F.struct(
        "code", F.col("name").alias("companyName"), F.col("document_id").alias("documentId"), F.lit(rules.DOCUMENT_TYPE).alias("documentType"), F.col("filed_at").alias("filedAt"),
        F.col("period_end").alias("periodEnd"), F.lit(rules.PERIOD_TYPE).alias("periodType"), F.lit(rules.SOURCE).alias("source"), F.concat(F.lit(rules.SOURCE_URL), "document_id").alias("sourceUrl"),
        F.lit(rules.SOURCE_DETAIL).alias("sourceDetail"), _metrics().alias("metrics"), F.array().alias("history"), F.struct("eps", "bps", F.lit(None).alias("forecastEps")).alias("valuation"),
        F.struct(F.col("policy"), F.lit(True).alias("autoFilled"), F.lit(rules.PARSER_VERSION).alias("parserVersion")).alias("quality"),
    )
    return df.select("code", record.cast(RECORD).alias("record"))


def replaced(records: DataFrame, new: DataFrame) -> DataFrame:
    """(code, record) with those of the same code replaced by new ones."""
    return records.join(new.select("code"), "code", "left_anti").unionByName(new)


def heads(records: DataFrame) -> DataFrame:
    """code, document_id and filed_at of records: what the choice of filings looks at."""
    return records.select("code", F.col("record.documentId").alias("document_id"), F.col("record.filedAt").alias("filed_at"))


def flat(records: DataFrame) -> DataFrame:
    """Records as columns that the company view takes: v_, p_, t_ and l_ of each KPI, valuation, margins of the history, provenance."""
    r = F.col("record")
    m = {k: F.try_element_at(r["metrics"], F.lit(k)) for k in rules.KPIS}
    parts = {"v": "value", "p": "previousValue", "t": "trend", "l": "comparisonLabel"}
    return records.select(
        "code", *(m[k][name].alias(f"{x}_{k}") for k in rules.KPIS for x, name in parts.items()), r["valuation"]["eps"].alias("eps"), r["valuation"]["bps"].alias("bps"), r["valuation"]["forecastEps"].alias("forecast_eps"),
        F.transform(r["history"], lambda h: h["operatingMargin"]).alias("history"), r["source"].alias("source"), r["filedAt"].alias("filed_at"), r["periodEnd"].alias("period_end"), r["sourceUrl"].alias("source_url"),
    )
