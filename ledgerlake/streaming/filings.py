"""The filing index as a stream: each micro-batch of landed index files brings the table of records up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules
from ..operators import filings
from ..operators.universe import missing
from ..sources.filings import INDEX_SCHEMA


def index_stream(spark: SparkSession, path: str) -> DataFrame:
    """Listed filings of index files as they land; one JSON line holds a day with its fetch_day."""
    days = spark.readStream.schema(f"fetch_day date, {INDEX_SCHEMA}").json(path)
    rows = days.select("fetch_day", F.posexplode("results").alias("day_seq", "f"))
    return rows.select(
        F.col("f.docID").alias("doc_id"), F.col("f.secCode").alias("sec_code"), F.col("f.docTypeCode").alias("doc_type_code"),
        F.col("f.submitDateTime").alias("submit_ts"), F.col("f.submitDate").alias("submit_date"), "fetch_day", "day_seq",
    )


def keep_current(
    spark: SparkSession, path: str, checkpoint: str, companies: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], valid: Callable[[DataFrame], DataFrame] = lambda found: found, as_of: str | None = None,
) -> StreamingQuery:
    """Starts a query that accepts newer filings of each batch into the records (code, document_id, filed_at, policy).

    read gives the records as they are and write replaces them; valid drops filings whose archive gives no record. A batch that
    is repeated after a failure changes nothing, as a filing isn't newer than itself. Day offsets count to as_of (today, unless given), so
    an old file that lands late is old. Ordinary companies without a record are missing targets.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        dated = filings.dated(batch, as_of or F.current_date())
        records = read()
        targets = missing(companies, records).filter(F.col("reason") == rules.ORDINARY).select("code").distinct()
        found = filings.candidates(filings.annual_filings(dated, companies), records, targets)
        write(filings.upserted(records, filings.latest_accepted(filings.accepted_filings(valid(found)))))

    return index_stream(spark, path).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
