"""Operator 1: a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row g of the corpus (in id order) goes to place p(g), where p is a keyed Feistel network on the smallest even
number of bits that covers all rows, walked along its cycle until the place is below the number of rows. Shard and
slot are p modulo and divided by the number of shards: any row's place, and the row of any place, can be computed
without looking at other rows, and shard sizes are at most one row apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import number_rows, text_bytes

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, seed: int, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = _mix(np.array([seed * ROUNDS + r + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]
        if back:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Place of each row among n rows; back=True: row of each place. rows must be below n."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    with np.errstate(over="ignore"):
        out = _network(np.asarray(rows).astype(np.uint64), half, seed, back)
        while (outside := out >= np.uint64(n)).any():
            out[outside] = _network(out[outside], half, seed, back)
    return out.astype(np.int64)


def shard_of(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_of(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """Global row number at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def shuffle_into_shards(docs: DataFrame, shards: int, order: list[str], seed: int = 0) -> DataFrame:
    """Adds row, shard and slot to every row of docs.

    order: columns that number the rows; rows that tie in all of them are interchangeable, nulls come first. Only
    the columns of docs travel through the one range shuffle, so callers leave texts out. An empty table stays empty.
    """
    numbered = number_rows(docs, order, "row")
    n = numbered.agg(F.max("row")).first()[0]
    n = 0 if n is None else n + 1

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("_place", place("row"))
    return placed.select(*numbered.columns, (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"))


def digest(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the global row number, for each row of documents.

    The law is `rows`: shard sizes in rows are at most one apart. Null or empty text: size 1, crc32 0. Rows with a null
    doc_id come first; repeated rows each get a slot of their own. Other columns of docs are ignored.
    """
    thin = docs.select(F.col("doc_id"), (text_bytes(F.col("text")) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shuffle_into_shards(thin, shards, ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
