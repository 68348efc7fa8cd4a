"""Operator 3: near-duplicate documents with HyperMinHash.

Sketch: a document's shingles are dealt to K buckets; a bucket keeps its smallest hash as a register of one byte, three
bits of its leading-zero count and five of mantissa (Yu and Weber, 2017). Buckets that stay empty are filled by further
rounds of dealing, and at last by a hash of their own, so that a register of two documents agrees with a probability
of their Jaccard similarity for small sets too. Bands of registers give candidates; the register agreement, corrected
for registers that agree by chance, drops those far below the threshold; the rest are confirmed on full shingle sets.

Documents with the same set are one class. A band's bucket is never expanded into rows of pairs: its members meet the
smallest of them, in the first bands, then the smallest and largest ones of the others where links haven't made them one component yet; and at
last the members meet those of different components in blocks, inside tasks, which give back only pairs whose registers agree well enough. So no
candidate is lost, and a group of copies costs about its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import components, joined_with_hot, joined_with_hubs, written
from .shingles import give_back, mix, shingle_sets, slices

SHINGLE_WORDS = 5
#: Eight rows a band keep documents that share a passage and little else apart; a hundred bands miss a pair right at
#: 75 % once in 37,000 times, one at 80 % practically never.
BANDS, ROWS = 100, 8
K = BANDS * ROWS
LZ_BITS, MANTISSA_BITS = 3, 5
#: Bands that are looked at first; nearly all members of a group of near copies share one of them with its smallest one.
FIRST = 12
#: Bits of a hash that order it within its bucket; the others choose the bucket.
VALUE_BITS = 40
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Standard deviations below the threshold at which an estimate still gets a pair confirmed.
SLACK = 5
#: Rounds of dealing before registers that are still empty get a hash of their own.
DEALS = 8
#: Sets that a task remembers, so as not to send the bands of copies again.
REMEMBERED = 1 << 18
#: Members from which a bucket's facts are sent to every task instead of its members to one; buckets that are sent at most.
HOT_BUCKET, MOST_HOT = 1000, 200_000
#: Pairs of a document from which they are dealt to several tasks.
HUB = 2000
#: Members of a bucket that are compared with each other in one task at a time.
BLOCK = 512

SKETCH = "doc_id long, h long, n_shingles long, k1 long, k2 long, registers binary"


def _register(value: np.ndarray, deal: int) -> np.ndarray:
    """Low bits of the leading-zero count and mantissa of 40-bit values; each deal shifts them by a number of its own."""
    bits = np.frexp(value.astype(np.float64))[1]
    mantissa = (value >> np.maximum(bits - 1 - MANTISSA_BITS, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA_BITS) - 1)
    zeros = (VALUE_BITS - bits).astype(np.uint64) & np.uint64((1 << LZ_BITS) - 1)
    return ((((zeros << np.uint64(MANTISSA_BITS)) | mantissa) + np.uint64(deal * 37)) & np.uint64(0xFF)).astype(np.uint8)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """K registers for each non-empty set."""
    none = np.uint64(1 << 63)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    out, empty = np.zeros((len(sets), K), dtype=np.uint8), np.ones((len(sets), K), dtype=bool)
    for deal in range(DEALS):
        rows = np.flatnonzero(empty.any(axis=1))
        if not len(rows):
            return out
        use = np.repeat(empty.any(axis=1), sizes)
        own = np.repeat(np.arange(len(rows)), sizes[rows])
        h = mix(flat[use] + np.uint64(deal + 1) * np.uint64(0x9E3779B97F4A7C15))
        best = np.full(len(rows) * K, none, dtype=np.uint64)
        np.minimum.at(best, own * K + (((h >> np.uint64(VALUE_BITS)) * np.uint64(K)) >> np.uint64(64 - VALUE_BITS)).astype(np.int64), h & np.uint64((1 << VALUE_BITS) - 1))
        best = best.reshape(len(rows), K)
        fill = empty[rows] & (best != none)
        r, c = np.nonzero(fill)
        out[rows[r], c] = _register(best[r, c], deal)
        empty[rows[r], c] = False
    keys = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    starts = np.cumsum(sizes) - sizes
    for row in np.flatnonzero(empty.any(axis=1)):  # sets of at most a few hundred shingles
        at = np.flatnonzero(empty[row])
        h = mix(flat[starts[row] : starts[row] + sizes[row], None] ^ keys[at]) >> np.uint64(64 - VALUE_BITS)
        out[row, at] = _register(h.min(axis=0), DEALS)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band: its eight registers and its number, mixed by a one-to-one function; the keys of the FIRST bands are even."""
    bands = np.ascontiguousarray(regs).view(np.uint64)
    keys = mix(bands ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))
    return ((keys & ~np.uint64(1)) | (np.arange(BANDS) >= FIRST).astype(np.uint64)).view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """A row for each document: row hash, size and 128-bit key of its shingle set, and registers (null if the set is empty, or its
    task has met it before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        with np.errstate(over="ignore"):
            for b in slices(batches, rows=2048):
                sets = shingle_sets(b.column("text"), SHINGLE_WORDS)
                full = [i for i, s in enumerate(sets) if len(s)]
                digests = [_digest(s) for s in sets]
                full = [i for i in full if digests[i] not in met and not met.add(digests[i])]
                if len(met) >= REMEMBERED:
                    met.clear()
                regs = registers([sets[i] for i in full]) if full else np.zeros((0, K), np.uint8)
                reg: list = [None] * len(sets)
                for j, i in enumerate(full):
                    reg[i] = regs[j].tobytes()
                id128 = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("h"), pa.array([len(s) for s in sets], pa.int64()), pa.array(id128[:, 0]), pa.array(id128[:, 1]), pa.array(reg, pa.binary())],
                    names=["doc_id", "h", "n_shingles", "k1", "k2", "registers"],
                )
        give_back()

    return docs.select("doc_id", "h", "text").mapInArrow(run, SKETCH)


def _matrix(registers: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(registers if isinstance(registers, pd.Series) else registers.to_pylist()), dtype=np.uint8).reshape(-1, K)


def _banded(sk: DataFrame) -> DataFrame:
    """(key, k1) for each band of each sketch with registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                keys = band_keys(_matrix(b.column("registers")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column("k1").to_numpy(), BANDS))], names=["key", "k1"])

    return sk.filter("registers is not null").select("k1", "registers").mapInArrow(run, "key long, k1 long")


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely registers of different minima agree: that of Yu and Weber, about 0.17 in 2^mantissa bits for sets of like
    size (fixed value), and of a leading-zero count that differs by a multiple of eight, which is negligible."""
    ratio = n / m
    return 0.169919487159739093975315012348 / (1 << MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - SLACK * (j * (1 - j) / K) ** 0.5


@F.pandas_udf(T.DoubleType())
def estimate(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Jaccard similarity from the share of equal registers, corrected for those that agree by chance."""
    if not len(a):
        return pd.Series([], dtype=float)
    c = chance(n.to_numpy(), m.to_numpy())
    return pd.Series(((_matrix(a) == _matrix(b)).mean(axis=1) - c) / (1 - c))


def _met_in_blocks(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a bucket in different components, both of whose registers agree well enough.

    rows: key, cid, component, blocks; reps: cid, n, registers. A bucket is cut into so many blocks, of about BLOCK members, by a hash of the cid; a pair of
    blocks is one piece of work, so a task holds two blocks at a time. Registers join the members once these are dealt. A pair that shares several buckets
    is given by its first band alone.
    """
    least = least_estimate(percent)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("blocks", "other")
    dealt = dealt.join(reps, "cid").select("key", "p", "q", "block", "cid", "component", "n", "registers")

    def compare(bucket: list[tuple]) -> tuple[list[int], list[int]]:
        key = bucket[0][0]
        first = [r for r in bucket if r[3] == r[1]]
        second = first if bucket[0][1] == bucket[0][2] else [r for r in bucket if r[3] == r[2]]
        if not first or not second:
            return [], []
        x, y = (np.frombuffer(b"".join(r[7] for r in rows), dtype=np.uint8).reshape(-1, K) for rows in (first, second))
        (cx, cy), (kx, ky), (nx, ny) = ([np.array([r[i] for r in rows]) for rows in (first, second)] for i in (4, 5, 6))
        band = int(np.flatnonzero(band_keys(x[:1])[0] == key)[0])
        left, right = [], []
        for i in range(len(first)):
            at = np.flatnonzero((ky != kx[i]) & (100 * np.minimum(ny, nx[i]) >= percent * np.maximum(ny, nx[i])) & ((cy > cx[i]) if second is first else (cy != cx[i])))
            if len(at):
                same = y[at] == x[i]
                c = chance(ny[at], np.full(len(at), nx[i]))
                ok = (same.mean(axis=1) - c) / (1 - c) >= least
                ok &= ~same[:, : band * ROWS].reshape(len(at), band, ROWS).all(axis=2).any(axis=1)
                left += [min(cx[i], z) for z in cy[at[ok]]]
                right += [max(cx[i], z) for z in cy[at[ok]]]
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        give = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0], pa.int64()), pa.array(x[1], pa.int64())], names=["a", "b"])
        with np.errstate(over="ignore"):
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and row[:3] != held[0][:3]:
                        yield give(compare(held))
                        held = []
                    held.append(row)
            if held:
                yield give(compare(held))

    pieces = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return pieces.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame) -> DataFrame:
    """Key and shingles of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches):
                sets = shingle_sets(b.column("text"), SHINGLE_WORDS)
                id128 = np.frombuffer(b"".join(map(_digest, sets)), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(id128[:, 0]), pa.array(id128[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k1", "k2", "shingles"])
        give_back()

    return docs.select("text").mapInArrow(run, "k1 long, k2 long, shingles array<long>")


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that are linked: by size and estimate first, then on full sets."""
    side = lambda x: reps.select(F.col("cid").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    pairs = written(pairs, "pairs")
    both = joined_with_hubs(pairs, side("a"), "a", pairs, HUB, MOST_HOT)
    both = joined_with_hubs(both, side("b"), "b", pairs, HUB, MOST_HOT)
    both = both.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    likely = written(both.filter(estimate("ra", "rb", "na", "nb") >= least_estimate(percent)).select("a", "b"), "likely")
    return _on_full_sets(likely, sets, percent)


def _on_full_sets(likely: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b), a written table, that are linked."""
    sets = sets.select(F.col("id"), F.col("shingles"))
    full = joined_with_hubs(likely, sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a", likely, HUB, MOST_HOT)
    full = joined_with_hubs(full, sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b", likely, HUB, MOST_HOT)
    common = F.size(F.array_intersect("sa", "sb"))
    return full.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Those of pairs(a, b) that are of different components so far."""
    of = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _placed(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row hash h, n_shingles, node, component_id and kept for each row of docs.

    Equal sets are one class, numbered by cid, as rows with different sets may share a doc_id. node is the smallest cid that
    links lead to, so it is one for each group, and null for rows that are linked with nothing by contract.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row_hash().alias("h"))
    sk = written(sketches(docs), "sketches")
    filled = sk.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.min("h").alias("h"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    banded = _banded(sk).repartition("key")
    shared = banded.groupBy("key").agg(F.min("k1").alias("x"), F.max("k1").alias("y")).filter("x < y").select("key")
    met = written(banded.join(shared, "key", "left_semi").distinct(), "met")
    named = met.join(classes.select("k1", "cid"), "k1").select("key", "cid")
    ends = written(named.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("n")).filter("lo < hi"), "ends")
    members = written(joined_with_hot(named, ends, ["key"], "n", HOT_BUCKET, MOST_HOT), "members")
    sketched = sk.filter("registers is not null").join(met.select("k1").distinct(), "k1", "left_semi")
    reps = sketched.join(classes, ["k1", "k2"]).select("cid", F.col("n_shingles").alias("n"), "registers").distinct()
    reps = written(reps, "reps")

    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi")
    sets = _sets(docs.join(wanted.select("h"), "h", "left_semi")).join(wanted.select("k1", "k2", F.col("cid").alias("id")), ["k1", "k2"])
    sets = written(sets.select("id", "shingles"), "sets").dropDuplicates(["id"])

    with_least = members.filter("cid > lo").select("key", F.col("lo").alias("a"), F.col("cid").alias("b"))
    with_largest = members.filter("cid < hi and cid > lo").select("key", F.col("cid").alias("a"), F.col("hi").alias("b"))
    early = F.col("key").bitwiseAND(1) == 0
    links = written(_confirmed(with_least.filter(early).select("a", "b").distinct(), reps, sets, percent), "links")
    found = written(components(links), "components")
    # the same for the other bands, and with the largest, where links haven't joined them
    later = with_least.filter(~early).union(with_largest).select("a", "b").distinct()
    more = written(_confirmed(_apart(later, found), reps, sets, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        found = written(components(links), "components")
    # the others of a bucket, where they are of several components
    placed = members.filter("cid > lo and cid < hi").select("key", "cid").join(found.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).filter("x < y").select("key", "n")
    split = split.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rest = written(joined_with_hot(placed, written(split, "split"), ["key"], "n", HOT_BUCKET, MOST_HOT), "rest")
    if not rest.isEmpty():
        likely = written(_met_in_blocks(rest, reps, percent), "likely")
        found = written(components(links.union(_on_full_sets(likely, sets, percent))), "components")

    linked = classes.select("cid", "least").join(found.withColumnRenamed("id", "cid"), "cid")
    linked = linked.join(linked.groupBy("component").agg(F.min("least").alias("name")), "component").select("cid", "component", "name")
    by_class = classes.join(linked, "cid", "left").select("k1", "k2", F.coalesce("component", "cid").alias("node"), F.coalesce("name", "least").alias("component"))
    out = sk.select("doc_id", "h", "n_shingles", "k1", "k2").join(by_class, ["k1", "k2"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0) | F.col("component").isNull()
    component, node = F.when(alone, F.col("doc_id")).otherwise(F.col("component")), F.when(~alone, F.col("node"))
    return out.select("doc_id", "h", "n_shingles", node.alias("node"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs(doc_id, text).

    component_id is the smallest doc_id that links lead to; kept says that a row is that document. Rows with an empty
    set, and rows without an id, are linked with nothing and kept. Where rows share an id but not a text, each gets the
    component of its own text. Null texts have an empty set; texts of any length count whole; rows that repeat get a row each. Documents that
    tie in similarity are all linked. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    return _placed(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near duplicates: of each component one row with the smallest id stays.

    Rows without an id, and without a word, stay.
    """
    found = written(_placed(docs, percent), "duplicates")
    named = found.filter("kept and node is not null")
    several = written(named.groupBy("node").agg(F.min("h").alias("stays"), F.count("*").alias("n")).filter("n > 1"), "several")
    spare = named.join(several, "node").filter("h <> stays")
    gone = found.filter("not kept").select("doc_id", "h").union(spare.select("doc_id", "h"))
    matches = lambda rows: (F.col("doc_id") == rows["_id"]) & (_row_hash() == rows["_h"])
    named_apart = lambda rows: rows.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    gone = named_apart(gone)
    left = docs.join(gone, matches(gone), "left_anti")
    if not several.isEmpty():
        twice = named_apart(named.join(several, "node").filter("h = stays"))
        again = left.join(twice, matches(twice), "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(twice, matches(twice), "left_anti").unionByName(again)
    return left.select(*docs.columns)
