"""Facts of filings: from raw elements to one row a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules
from ..functions.scalar import bucket_of, first_match, local_name, number, plain_number, strip


def parsed_facts(raw: DataFrame, prior: str = "prioryear") -> DataFrame:
    """Metric, bucket and value of raw elements (tag, context_ref, text); others are dropped.

    The table of element names is a fixed list of cases, so nothing is joined. What is worked out is exploded, so that filters on it stay
    above and don't work it out again; numbers are parsed only of elements that are wanted. Each step is a column that the next one uses more than
    once, as a lambda would be interpreted row by row.
    """
    once = lambda df, keep, **made: df.select(*keep, F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("_")).select(*keep, *(F.col(f"_.{n}").alias(n) for n in made))
    df = raw.drop("metric", "bucket", "value")
    given = [F.col(c) for c in df.columns]
    df = once(df, given, _local=local_name(F.col("tag")), _low=F.lower("context_ref"))
    metric = first_match([(F.col("_local").isin(*tags), m) for m, tags in rules.METRIC_TAGS.items()])
    named = [*given, F.col("metric"), F.col("bucket")]
    df = once(df, given, metric=metric, bucket=bucket_of(F.col("_low"), prior)).filter("metric is not null and bucket is not null")
    df = once(df, named, _text=strip(F.col("text")))
    df = once(df, named, _plain=plain_number(F.col("_text")))
    return once(df, named, value=number(F.col("_plain"))).filter(F.abs("value") < float("inf"))


def of_documents(facts: DataFrame, wanted: DataFrame, most_sent: int = 1_000_000) -> DataFrame:
    """The facts of wanted documents (doc_id), cut down before anything shuffles them.

    Up to most_sent ids are sent to every task (20 bytes each), so that facts of others never leave theirs. More are sent as a bitmap of their hashes first,
    which lets one fact in ten of others pass, and what passes is joined.
    """
    ids = wanted.select("doc_id").distinct()
    n = ids.count()
    if n <= most_sent:
        return facts.join(F.broadcast(ids), "doc_id", "left_semi")
    # bitmaps of 32,768 bits each, a row of 4 KB; ten bits for each id
    place = F.pmod(F.xxhash64("doc_id"), F.lit(10 * n))
    bits = ids.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = facts.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket").filter(F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1)
    return likely.drop("_bucket", "_bits").join(ids, "doc_id", "left_semi")


def picked_facts(facts: DataFrame, place: str = "seq") -> DataFrame:
    """A1: one value for each document, metric and bucket: the first in document order, of debts the sum."""
    groups = facts.groupBy("doc_id", "metric", "bucket").agg(F.min_by("value", place).alias("first"), F.sum("value").alias("total"))
    value = F.when(F.col("metric") == rules.SUMMED_METRIC, F.col("total")).otherwise(F.col("first"))
    return groups.select("doc_id", "metric", "bucket", value.alias("value"))


def wide_facts(facts: DataFrame, place: str = "seq") -> DataFrame:
    """A1 and A2 in one aggregation: a row for each document, a column for each metric and bucket. One shuffle by document."""
    columns = []
    for m in rules.METRIC_TAGS:
        for b in rules.BUCKETS:
            here = (F.col("metric") == m) & (F.col("bucket") == b)
            pick = F.sum(F.when(here, F.col("value"))) if m == rules.SUMMED_METRIC else F.min_by("value", F.when(here, F.col(place)))
            columns.append(pick.alias(f"{m}_{b}"))
    return facts.groupBy("doc_id").agg(*columns)
