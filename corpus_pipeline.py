"""A training corpus from documents: language, near duplicates, benchmark leaks, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their columns; the last
one returns a row for each record that it has written and read back. Stages learn and count on what their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm import decontamination, langid, mixing, near_dedup, records
from ledgerlake.llm.common import table, written
from ledgerlake.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those far from every centroid, go (operator 6). Null and empty texts go; long texts count whole; rows that
    repeat or share an id are judged one by one; columns of any name stay as they are; an empty table stays empty."""
    return langid.known_languages(docs, langid.learn(docs))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 3), the one with the smallest id; of rows that tie in it, one. Rows without an
    id or a word stay; texts count whole; columns of any name but doc_id and text are looked past."""
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go (operator 7), by id and text: clean rows that share a leaking one's id, or have none, stay.
    Null texts stay; an empty benchmark takes nothing; columns of any name stay as they are."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (operator 8). A null source is one of its own, null texts have no words; rows that tie in source,
    size and id are interchangeable, and rows that repeat as a whole each count; columns of any name stay as they are."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in record files, read back (operator 10). Null texts are their end id alone, null ids come first, repeated rows get a record each. Rows
    that tie in their id are ordered by text; other columns, whatever their names, are left out; an empty table gives no rows."""
    return records.digest(docs, tokenizer_path())


STAGES = [
    ("language id", language),
    ("near duplicates", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", encoded),
]

#: SQL has neither the sketches of stage 2 nor the tokenizer of stage 5; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; between stages the documents are written and read again."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = written(stage(spark, out, sf_dir), name.replace(" ", "-"))
    return out
