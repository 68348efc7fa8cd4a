"""Operator 7: benchmark decontamination with spaced seeds, in DataFrame functions alone.

Texts are words in lower case (letters and digits); of scripts without spaces each letter is a word. Fixed masks pick some of the words of each window and ignore the
others, so a substituted word spoils only the windows in which the mask looks at it. Hashes of the picked words are
joined between benchmark and documents; a hit fixes an alignment, and the words of both are compared along it. A
document leaks an item if some WINDOW aligned words (all of a shorter item) agree in SHARE of their places; places beyond
the document's ends count as places that differ.

The masks miss no leak. Items of up to SHORT words have masks of their own length, which leave out every set of places that SHARE lets differ;
of longer ones, three places of a window may differ, and whichever do, one of the three MASKS (found by search over all masks of six words) has
a position in 15 words in a row that looks at none of them. Items of LEAST_WORDS words must be whole: four words alone identify too little.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

#: Fixed masks: offsets of the words that count.
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 8, 9, 10), (0, 1, 3, 5, 6, 10))
WINDOW = 16
SHARE = 0.8
#: Items with fewer words identify nothing and never match.
LEAST_WORDS = 5
#: Words up to which items have masks of their own length.
SHORT = 14
#: Letters of scripts that are written without spaces: Thai, Lao, Burmese, Khmer, kana and Han.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}]"
#: Seeds of the benchmark up to which they are broadcast (about 40 bytes each); more are joined by a shuffle.
BROADCAST_SEEDS = 500_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order; empty for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.when(low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    words = F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def required(length: int) -> int:
    """Words of so many beside each other that must agree: SHARE of them, and all of LEAST_WORDS."""
    return length if length <= LEAST_WORDS else math.ceil(length * SHARE)


def masks_of(length: int) -> list[tuple[int, ...]]:
    """Masks for items of so many words: whatever places differ, as far as SHARE allows, some mask looks at none of them."""
    differ = length - required(length)
    step = length // (differ + 2)
    groups = [range(i, min(i + step, length)) for i in range(0, length, step)]
    masks = set()
    for out in combinations(groups, differ):
        offsets = [i for i in range(length) if not any(i in g for g in out)]
        masks.add(tuple(i - offsets[0] for i in offsets))
    return sorted(masks)


def _seeds(w: str, number: int, offsets: tuple[int, ...], length: int | None) -> str:
    span = offsets[-1] + 1
    picked = ", ".join(f"{w}[i + {o}]" for o in offsets)
    fits = f"size({w}) >= {span}" + (f" and size({w}) = {length}" if length else "")
    return f"if({fits}, transform(sequence(0, size({w}) - {span}), i -> xxhash64({number}, {picked})), array())"


def _seed_rows(df: DataFrame, keep: list[str], masks: list[tuple[tuple[int, ...], int | None]], items: bool = False) -> DataFrame:
    """keep, seed and position for every window of column w and every mask; of items, a mask for a length takes those of that length."""
    arrays = df.select(*keep, *(F.expr(_seeds("w", k, m, n if items else None)).alias(f"s{k}") for k, (m, n) in enumerate(masks)))
    each = F.posexplode(F.concat(*(f"s{k}" for k in range(len(masks)))))
    rows = arrays.select(*keep, *(F.size(f"s{k}").alias(f"n{k}") for k in range(len(masks))), each.alias("p", "seed"))
    before, at = F.lit(0), F.col("p")  # each mask's positions begin at 0
    for k in range(len(masks) - 1):
        before = before + F.col(f"n{k}")
        at = F.when(F.col("p") >= before, F.col("p") - before).otherwise(at)
    return rows.select(*keep, "seed", at.alias("at"))


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row hash h, item_id, matched, aligned and doc_start for each alignment that leaks an item."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("w")).filter(F.size("w") >= LEAST_WORDS).distinct()
    items = written(items, "items")
    short = [r[0] for r in items.filter(F.size("w") <= SHORT).select(F.size("w")).distinct().sort(F.size("w")).collect()]  # ten lengths at most
    masks = [*((m, None) for m in MASKS), *((m, n) for n in short for m in masks_of(n))]
    seeds = _seed_rows(items, ["item_id"], masks, items=True).withColumnRenamed("at", "item_at")
    small = seeds.count() <= BROADCAST_SEEDS

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    found = _seed_rows(rows.select("h", word_hashes(F.col("text")).alias("w")), ["h"], masks)
    hits = found.join(F.broadcast(seeds) if small else seeds, "seed")
    hits = written(hits.select("h", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")

    texts = rows.join(hits.select("h").distinct(), "h", "left_semi").dropDuplicates(["doc_id", "h"])
    texts = texts.select("doc_id", "h", word_hashes(F.col("text")).alias("d"))
    pairs = hits.join(texts, "h").join(F.broadcast(items) if small else items, "item_id")
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("w"), F.size("d") - F.col("shift"))
    pairs = pairs.withColumn("first", first).withColumn("aligned", last - first)
    same = F.expr("transform(sequence(first, first + aligned - 1), i -> if(w[i] = d[i + shift], 1, 0))")
    pairs = pairs.withColumn("same", same).withColumn("window", F.least(F.lit(WINDOW), F.size("w")))
    least = F.when(F.col("window") <= LEAST_WORDS, F.col("window")).otherwise(F.ceil(F.col("window") * SHARE))
    matched = F.expr("aggregate(same, 0, (a, x) -> a + x)")
    # a window is WINDOW words at most, so summing each anew is in proportion to the aligned words
    inside = F.expr("array_max(transform(sequence(0, aligned - window), i -> aggregate(slice(same, i + 1, window), 0, (a, x) -> a + x)))")
    pairs = pairs.withColumn("best", F.when(F.col("aligned") >= F.col("window"), inside).otherwise(matched))
    return pairs.filter(F.col("best") >= least).select("doc_id", "h", "item_id", matched.alias("matched"), "aligned", (F.col("first") + F.col("shift")).alias("doc_start"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, aligned and doc_start for each document and item that it leaks; clean documents have no row.

    Of several alignments of an item the one with the most agreeing words counts, then the earliest. aligned is
    the number of words that lie beside each other and doc_start the document's first of them. Null or empty texts leak
    nothing; documents with a null id are reported with it; repeated rows give one row; items that are null, or have fewer
    than LEAST_WORDS words (see unusable_items), never match. Whole texts count, however long. Other columns are ignored.
    """
    best = _found(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", (-F.col("doc_start")).alias("n"), "aligned")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("b.aligned").cast("long").alias("aligned"), (-F.col("b.n")).cast("long").alias("doc_start"))


def unusable_items(benchmark: DataFrame) -> DataFrame:
    """item_id and words of the items that never match, as they have fewer than LEAST_WORDS words."""
    return benchmark.select("item_id", F.size(word_hashes(F.col("text"))).alias("words")).filter(F.col("words") < LEAST_WORDS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text leaks no item, with columns of any name; rows that share their id, or have none, are told apart by a hash of
    their text."""
    bad = _found(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("h").alias("bad_h")).distinct()
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("h"))
    return packed.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("h") == F.col("bad_h")), "left_anti").select("row.*")


def _oracle() -> str:
    """Every alignment of a document and an item that share three words in a row is compared. Of words that leak an item some three lie so, whatever
    places SHARE lets differ, so this stands on no mask."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    three = lambda table, key: f"select {key}, i, t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3] as seed from (select {key}, t, unnest(range(len(t) - 2)) as i from {table} where len(t) >= 3)"
    return f"""
with b as (select item_id, {words} as t, len(t) as n from benchmark where len({words}) >= {LEAST_WORDS}),
d as (select doc_id, {words} as t from documents),
bs as ({three('b', 'item_id')}), ds as ({three('d', 'doc_id')}),
hits as (select distinct doc_id, item_id, ds.i - bs.i as shift from ds join bs using (seed)),
al as (select doc_id, item_id, shift, b.t as w, d.t as x, least({WINDOW}, b.n) as win, greatest(0, -shift) as first, least(b.n, len(d.t) - shift) - greatest(0, -shift) as aligned
       from hits join b using (item_id) join d using (doc_id)),
sm as (select doc_id, item_id, shift, first, aligned, win, list_transform(range(first, first + aligned), lambda i: cast(w[i + 1] = x[i + shift + 1] as int)) as same from al),
per as (select doc_id, item_id, list_sum(same) as matched, aligned, first + shift as doc_start, case when win <= {LEAST_WORDS} then win else ceil(win * {SHARE}) end as least,
        case when aligned >= win then list_max(list_transform(range(aligned - win + 1), lambda i: list_sum(same[i + 1 : i + win]))) else list_sum(same) end as best from sm),
one as (select *, row_number() over (partition by doc_id, item_id order by matched desc, doc_start) as rn from per where best >= least)
select doc_id, item_id, cast(matched as bigint) as matched, cast(aligned as bigint) as aligned, cast(doc_start as bigint) as doc_start from one where rn = 1
"""


#: DuckDB: all alignments, without masks.
ORACLE = _oracle()
