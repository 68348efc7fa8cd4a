"""Operator 12: spelling variants of words by PartEnum signatures.

A word's letters, as a multiset, are a binary vector with a place for each first, second, third... occurrence of a letter. One inserted or
deleted code point changes one place of it and a replaced one two, so near words have vectors of Hamming distance one or two. PartEnum
(Arasu, Ganti and Kaushik, 2006) deals the places into FIRST parts, of which one must differ in at most FEW places, and each of those into
SECOND parts, of which at most FEW differ; every choice of the others makes a signature, so that vectors within the distance share one exactly.

Words of the same letters are one vector and never near. Signatures are equi-joined by vector, pairs whose bitmaps
differ in more than two bits fall out inside the join, and the words of the pairs that are left are verified by edit distance inside the join
that brings them together; only near words become rows. A word has at most a few hundred near words, as many as there are edits.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import written

#: Upper case and lower case as the contract folds them.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([A-Za-zÀ-ÿ]+)"
#: A run loses a letter where this divides its hash.
TYPO = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: Times as frequent as the word its form is, at least.
RATIO = 5
#: Hamming distance, parts of the first and second level, and places that may differ in the best first-level part. One first-level part
#: and seven below it make 21 signatures; two parts with fewer signatures compared 16 times as many words.
DISTANCE, FIRST, SECOND = 2, 1, 7
FEW = -(-(DISTANCE + 1) // FIRST) - 1


def counted_words(docs: DataFrame) -> DataFrame:
    """word and n: runs of letters, some with a letter taken out by a hash of the row's id and the run, counted over all texts."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("at"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(1))).alias("run"))
    runs = runs.filter(F.char_length("run") >= LEAST_LENGTH).withColumn("run", F.translate("run", UPPER, LOWER))
    hashed = F.crc32(F.concat("at", F.lit(":"), "run").cast("binary"))
    runs = runs.withColumn("h", hashed)
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _bits(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(letters: str, few: int = FEW, first: int = FIRST, second: int = SECOND) -> tuple[list[int], int, int]:
    """The signatures of a multiset of letters, and a bitmap of 128 bits in which each place of its vector flips one bit.

    A signature is a hash of which parts it is made of and of the places in them that are set.
    """
    parts = [0] * (first * second)
    bitmap = [0, 0]
    for c, n in Counter(letters).items():
        for nth in range(1, n + 1):
            h = xxhash.xxh64_intdigest(f"{c}{nth}")
            parts[(3 * ord(c) + nth) % len(parts)] ^= h
            bitmap[h >> 6 & 1] ^= 1 << (h & 63)
    out = []
    for i in range(first):
        here = parts[i * second : (i + 1) * second]
        for left_out in itertools.combinations(range(second), min(few, second)):
            kept = ",".join(str(0 if j in left_out else h) for j, h in enumerate(here))
            out.append(_bits(xxhash.xxh64_intdigest(f"{i}:{left_out}:{kept}")))
    return out, _bits(bitmap[0]), _bits(bitmap[1])


def _entries(vectors: DataFrame) -> DataFrame:
    """A row for each signature of each vector: sig, letters, length and the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                sigs, letters, lengths, low, high = [], [], [], [], []
                for s in b.column("letters")[part : part + 1000].to_pylist():
                    found, x, y = signatures(s)
                    sigs += found
                    letters += [s] * len(found)
                    lengths += [len(s)] * len(found)
                    low += [x] * len(found)
                    high += [y] * len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs, pa.int64()), pa.array(letters, pa.string()), pa.array(lengths, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                    names=["sig", "letters", "length", "low", "high"],
                )

    return vectors.mapInArrow(run, "sig long, letters string, length int, low long, high long")


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_a and n_b for each pair of words (a < b) that differ by one edit. words: word, n, as a written table."""
    lettered = words.withColumn("letters", F.array_join(F.array_sort(F.split("word", "")), ""))
    vectors = lettered.select("letters").distinct()
    entries = _entries(vectors)
    a, b = entries.alias("a"), entries.alias("b")
    apart = F.bit_count(F.col("a.low").bitwiseXOR(F.col("b.low"))) + F.bit_count(F.col("a.high").bitwiseXOR(F.col("b.high")))
    near = (F.col("a.letters") < F.col("b.letters")) & (F.abs(F.col("a.length") - F.col("b.length")) <= 1) & (apart <= DISTANCE)
    pairs = a.join(b, (F.col("a.sig") == F.col("b.sig")) & near).select(F.col("a.letters").alias("x"), F.col("b.letters").alias("y")).distinct()
    left = lettered.select(F.col("letters").alias("x"), F.col("word").alias("p"), F.col("n").alias("n_p"))
    right = lettered.select(F.col("letters").alias("z"), F.col("word").alias("q"), F.col("n").alias("n_q"))
    found = pairs.join(left, "x").join(right, (F.col("y") == F.col("z")) & (F.levenshtein("p", "q", 1) == 1))
    swap = F.col("p") > F.col("q")
    pick = lambda s, t: F.when(swap, F.col(t)).otherwise(F.col(s))
    return found.select(pick("p", "q").alias("a"), pick("q", "p").alias("b"), pick("n_p", "n_q").alias("n_a"), pick("n_q", "n_p").alias("n_b"))


def roots(words: DataFrame) -> DataFrame:
    """word and root for every row of words (word, form), where forms are followed to the last. A form is RATIO times as frequent as its word, so
    chains are short and end; each round follows twice as many steps as the one before."""
    now = written(words.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next")).filter("root <> next")
        if not now.join(further, "root", "left_semi").take(1):
            return now
        now = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root for each frequent word of all texts.

    Words are runs of Latin letters, folded in A-Z only, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences. Null and empty texts have
    none, and a null id is an empty one in the hash that takes letters out. Rows that repeat count each. Words of any
    length take part whole. Of near words that tie in frequency the first in code-point order is the form. An empty table gives no rows; columns but
    doc_id and text are ignored.
    """
    words = written(counted_words(docs), "words")
    pairs = written(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select("b", "a", "n_a"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    valid = -F.col("best.m") >= RATIO * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(valid, F.col("best.other")).alias("form"), F.when(valid, -F.col("best.m")).alias("form_n"))
    known = written(known, "forms")
    return known.join(roots(known), "word").select("word", "n", "n_near", "form", "form_n", "root")


#: crc32 by its table, which follows from the polynomial; near words share a word without one letter, or are it.
ORACLE = f"""
with tab as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select cast(range as bigint) as i from range(256)))),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') as run from documents),
counted as (select doc_id, run, count(*) as k from runs where length(run) >= {LEAST_LENGTH} group by all),
bytes as (select run, k, flatten(list_transform(string_split(coalesce(cast(doc_id as varchar), '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [195, unicode(c) - 64] end)) as b from counted),
hashed as (select run, k, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as h from bytes, tab),
cut as (select case when h % {TYPO} = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, k from hashed),
words as (select word, cast(sum(k) as bigint) as n from cut where length(word) >= {LEAST_LENGTH} group by word having sum(k) >= {LEAST_COUNT}),
less as (select distinct word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word, b.word as other, b.n as m from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select a.word, b.word, b.n from less a join words b on a.rest = b.word union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, arg_min(other, (-m, other)) as other, max(m) as m from near group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= {RATIO} * n then other end as form, case when m >= {RATIO} * n then m end as form_n from words w left join best b on w.word = b.word),
ways as (with recursive go as (select word, word as root, form as next from forms union all select g.word, f.word, f.form from go g join forms f on g.next = f.word) select word, root from go where next is null)
select f.word, n, n_near, form, form_n, root from forms f join ways w on f.word = w.word
"""
