"""Search by an inverted index of grams (P21, F8), and pages of a sorted view by a page index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules
from ..sources.placing import starts, stored_in_order
from .screen import fold_needle, screened, sort_key

#: Lengths of the grams of an index.
GRAMS = (1, 2, 3)
#: What a query is looked for in: as it is typed, and folded.
FIELDS = {"name": "lower(name)", "code": "code", "name_fold": "name_fold", "code_fold": "code_fold"}


def postings(view: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """field, gram and seq for each distinct gram of each field of each company: the index, to be stored in buckets of gram.

    Postings are rows, so that a gram of very many companies is no single value.
    """
    grams = []
    for n in GRAMS:
        places = f"sequence(1, greatest(char_length(t) - {n - 1}, 0))"
        grams.append(f"if(char_length(t) >= {n}, transform({places}, i -> substring(t, i, {n})), array())")
    texts = view.select("seq", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.expr(e).alias("t")) for f, e in fields.items()))).alias("x")).select("seq", "x.*").filter("t <> ''")
    return texts.select("field", "seq", F.explode(F.array_distinct(F.concat(*map(F.expr, grams)))).alias("gram"))


def grams_of(needle: str) -> list[str]:
    """The grams that a text with the needle has: itself if it is short, else all of the greatest length."""
    n = min(len(needle), GRAMS[-1])
    return list(dict.fromkeys(needle[i : i + n] for i in range(len(needle) - n + 1)))


def found(index: DataFrame, needles: dict[str, str]) -> DataFrame:
    """seq of the companies that have every gram of a field's needle in that field, for any of the fields.

    Only postings of those grams are read: buckets of others are left out by the filter. For needles of a gram's length that is the answer.
    """
    every = []
    for field, needle in needles.items():
        grams = grams_of(needle)
        rows = index.filter((F.col("field") == field) & F.col("gram").isin(grams))
        every.append(rows.groupBy("seq").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("seq") if len(grams) > 1 else rows.select("seq"))
    return reduce(DataFrame.union, every).distinct()


def searched(view: DataFrame, index: DataFrame, query: str, **more) -> DataFrame:
    """F8 as screened does it, for a view with folded names: the query goes through the index, and what it finds is looked at again."""
    q = query.strip().lower()
    folded = fold_needle(q)
    if not q or not folded:
        return screened(view, query, **more)
    hits = found(index, {"name": q, "code": q, "name_fold": folded, "code_fold": folded})
    return screened(view.join(hits, "seq", "left_semi"), query, **more)


def page_index(view: DataFrame, path: str, order: str = "score-desc") -> tuple[DataFrame, DataFrame]:
    """The view written below path in ranges of a sort order, a folder each, and the number of rows in each range and before it."""
    placed = stored_in_order(view, sort_key(order), path, folders=True)
    counts = starts(placed)
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}-counts")  # a row a range
    return placed, view.sparkSession.read.schema(counts.schema).parquet(f"{path}-counts")


def opened_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A page index that was written before."""
    return spark.read.parquet(path), spark.read.parquet(f"{path}-counts")


def indexed_page(index: tuple[DataFrame, DataFrame], number: int, size: int = rules.PAGE_SIZE) -> DataFrame:
    """A page (from 1), read from the one or two ranges that hold it, however far back it lies; with place, from 0."""
    placed, counts = index
    first, last = (number - 1) * size, number * size
    parts = counts.filter((F.col("first") < last) & (F.col("first") + F.col("rows") > first)).select("_part", "first").collect()  # the page's ranges: size at most
    if not parts:
        return placed.filter(F.lit(False)).withColumn("place", F.lit(0).cast("long")).drop("_part", "_nth")
    start = F.create_map(*(F.lit(x) for p in parts for x in (p["_part"], p["first"])))
    rows = placed.filter(F.col("_part").isin([p["_part"] for p in parts])).withColumn("place", F.element_at(start, F.col("_part")) + F.col("_nth"))
    return rows.filter((F.col("place") >= first) & (F.col("place") < last)).drop("_part", "_nth").orderBy("place").limit(size)
