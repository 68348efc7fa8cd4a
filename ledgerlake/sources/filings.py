"""Daily filing indexes (S3) and filing archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

INDEX_SCHEMA = "results array<struct<docID:string,secCode:string,docTypeCode:string,submitDateTime:string,submitDate:string,periodEnd:string>>"
FACTS = "doc_id string, member_idx int, elem_idx int, tag string, context_ref string, text string, error string"
#: Archive members that are read, those of the public document first.
MOST_MEMBERS = 3


def read_filing_index(spark: SparkSession, path: str, fetch_day: Column | None = None) -> DataFrame:
    """One row a listed filing with its place in the day's list. One JSON file holds a day.

    fetch_day is a partition column if the folder is laid out by it, else the date in the file's name. Either is known before a file is opened, so a
    range of days in a filter (see operators.filings.dated) leaves the files of other days closed.
    """
    days = spark.read.schema(INDEX_SCHEMA).json(path, multiLine=True)
    if fetch_day is not None or "fetch_day" not in days.columns:
        days = days.withColumn("fetch_day", F.to_date(F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1)) if fetch_day is None else fetch_day)
    rows = days.select("fetch_day", F.posexplode("results").alias("day_seq", "f"))
    return rows.select(
        F.col("f.docID").alias("doc_id"), F.col("f.secCode").alias("sec_code"), F.col("f.docTypeCode").alias("doc_type_code"),
        F.col("f.submitDateTime").alias("submit_ts"), F.col("f.submitDate").alias("submit_date"), F.col("f.periodEnd").alias("period_end"), "fetch_day", "day_seq",
    )


def archive_facts(doc_id: str, read: Callable[[], bytes]) -> list[tuple]:
    """Every element with a context of an archive's first XBRL members. An archive of which anything fails gives one row with the
    error and no fact."""
    rows = []
    try:
        with zipfile.ZipFile(io.BytesIO(read())) as z:
            names = [n for n in z.namelist() if n.endswith(".xbrl")]
            public = [n for n in names if "PublicDoc" in n]
            for m, name in enumerate((public or names)[:MOST_MEMBERS]):
                for e, element in enumerate(ElementTree.fromstring(z.read(name)).iter()):
                    if ref := element.attrib.get("contextRef"):
                        rows.append((doc_id, m, e, element.tag, ref, element.text, None))
    except Exception as bad:  # whatever is wrong with one archive must not end the job
        return [(doc_id, None, None, None, None, None, f"{type(bad).__name__}: {bad}")]
    return rows


def _bytes_of(path: str) -> bytes:
    """A file's content, read inside a task: local paths, object stores and hdfs."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, at = (LocalFileSystem(), path[5:]) if path.startswith("file:") else FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return f.read()


def read_archives(spark: SparkSession, path: str, doc_ids: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Facts of zipped XBRL filings, one row an element; a file is named after its document.

    Only names are listed, joined with doc_ids(doc_id) and dealt to so many tasks (shuffle partitions, unless given), as parsing costs far
    more than the names' shuffle; a task opens the archives that are left, one at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("doc_id"), "path")
    if doc_ids is not None:
        files = files.join(doc_ids, "doc_id", "left_semi")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for b in batches:
            for doc_id, name in zip(b["doc_id"], b["path"], strict=True):
                rows = pd.DataFrame(archive_facts(doc_id, lambda: _bytes_of(name)), columns=columns)
                yield rows.astype({"member_idx": "Int32", "elem_idx": "Int32"})

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))  # a given number, which small names don't lower
    return files.repartition(tasks, "doc_id").mapInPandas(parse, FACTS)
