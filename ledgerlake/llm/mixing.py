"""Operator 8: mixing sources to target weights by systematic sampling.

Each document of a source is expected target / source size times. The expected copies are summed along the source
(documents by size, so that large ones are spread evenly), one random offset a source is added, and a document is
emitted once for each integer that the sum crosses at it. Copies of a document so differ from the expectation by
less than one, and the words taken from a source miss its target by no more than about the size of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import number_rows, word_count, written

MAX_REPEATS = 3
#: Sources up to which their targets are broadcast (about 60 bytes each); more are joined by a shuffle, where AQE splits hot sources.
BROADCAST_SOURCES = 200_000


def source_key(source: Column) -> Column:
    """A non-null text that sorts sources by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def offset(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """(key, source_size, docs) -> also weight and target.

    Sources by key weigh 1, 2, 3, repeating, and share the total size; none gets more than repeats times its size, and
    what it can't take is shared by the others by weight. The level at which shares stop is found with two running
    sums over the sources in the order in which they reach their limit. One task sees all sources, one small row each, and no document.
    """
    w = sizes.withColumn("weight", (F.row_number().over(W.orderBy("key")) - 1) % 3 + 1)
    w = w.withColumn("_cap", F.col("source_size") * repeats)
    by_limit = W.orderBy(F.col("_cap") / F.col("weight"), "key")
    before, after = by_limit.rowsBetween(W.unboundedPreceding, -1), by_limit.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    w = w.withColumn("_level", left / F.sum("weight").over(after))
    # the first source that stays below its limit sets the level for itself and all after it
    open_ = F.when(F.col("_cap") > F.col("_level") * F.col("weight"), F.col("_level"))
    level = F.first(open_, ignorenulls=True).over(by_limit.rowsBetween(W.unboundedPreceding, 0))
    w = w.withColumn("target", F.coalesce(F.least(F.col("_cap").cast("double"), level * F.col("weight")), F.col("_cap").cast("double")))
    return w.select("key", "source_size", "docs", "weight", "target")


def copies_per_document(docs: DataFrame, seed: int = 0, repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds source_size, target and copies to rows of (doc_id, source, size), without shuffling anything else.

    Null or empty texts have size 0 and may get copies, which add no words. A null source is a source of its own.
    Repeated rows are documents of their own; the order within a source is by size, then doc_id, and rows that tie in
    both are interchangeable. A hot source is split over tasks by size and id, and documents are not dealt by source: sources are summed in every
    task first, and their targets broadcast up to BROADCAST_SOURCES.
    """
    numbered = number_rows(docs.withColumn("key", source_key(F.col("source"))), ["key", "size", "doc_id"], "row")
    sizes = numbered.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.min("row").alias("first_row"))
    plan = targets(sizes.select("key", "source_size", "docs"), repeats)
    plan = plan.join(sizes.select("key", "first_row"), "key").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("offset", offset(F.col("key"), seed))
    plan = written(plan.select("key", "source_size", "target", "first_row", "rate", "offset"), "plan")
    out = numbered.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, "key")
    i = (F.col("row") - F.col("first_row")).cast("double")
    copies = F.floor((i + 1) * F.col("rate") + F.col("offset")) - F.floor(i * F.col("rate") + F.col("offset"))
    return out.withColumn("copies", copies.cast("long")).drop("key", "row", "first_row", "rate", "offset")


def digest(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; size counts words, 0 for null texts."""
    thin = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    out = copies_per_document(thin, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs whatever their names.

    Copies are joined back by doc_id and a hash of the row. Rows that repeat as a whole are one row with the sum of their copies. Null or
    empty texts have no words, and stay if their place is reached; null ids and sources are like others; an empty table stays empty.
    """
    full = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("*").alias("h"))
    thin = written(full.select("doc_id", "source", "size", "h"), "sizes")
    taken = copies_per_document(thin, seed).groupBy(F.col("doc_id").alias("id"), F.col("h").alias("hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = written(taken, "taken")
    full = full.select("row", "doc_id", "h")
    if not taken.filter("n > 1").isEmpty():
        full = full.groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("hash"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return full.join(taken.filter("copies > 0"), same).select("row", copy).select("row.*")


#: DuckDB: the same arithmetic over the documents view.
ORACLE = r"""
with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
             coalesce('0' || source, '1') as key from documents),
s as (select key, cast(sum(size) as bigint) as source_size from d group by key),
w as (select *, (row_number() over (order by key) - 1) % 3 + 1 as weight, source_size * 3 as cap from s),
l as (select *, (cast((select sum(source_size) from s) as bigint)
             - cast(coalesce(sum(cap) over (order by cap / cast(weight as double), key rows between unbounded preceding and 1 preceding), 0) as bigint))
             / cast(sum(weight) over (order by cap / cast(weight as double), key rows between current row and unbounded following) as double) as level from w),
m as (select *, first_value(case when cap > level * weight then level end ignore nulls)
             over (order by cap / cast(weight as double), key rows between unbounded preceding and current row) as held from l),
t as (select key, source_size, coalesce(least(cast(cap as double), held * weight), cast(cap as double)) as target,
        cast(('0x' || substr(md5('0:' || key), 1, 13)) as bigint) / 4503599627370496.0::double as off from m),
r as (select key, target, source_size, off, case when source_size > 0 then target / source_size else 0.0::double end as rate from t),
i as (select d.doc_id, d.size, r.*, cast(row_number() over (partition by d.key order by d.size, d.doc_id nulls first) - 1 as double) as i
      from d join r on d.key = r.key),
c as (select *, cast(floor((i + 1) * rate + off) - floor(i * rate + off) as bigint) as copies from i)
select doc_id, size, source_size, target, copies * size as taken, copies from c
"""
