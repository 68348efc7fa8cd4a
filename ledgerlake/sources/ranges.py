"""Entries of one large JSON object, read by many tasks in ranges of bytes.

Where a range begins, nothing says whether that is inside a string or how deep. So each range first tells, for either case, how it would change both:
its unescaped quotes, and the braces that lie outside strings if it begins outside one, or inside. Composed over the ranges in order, one small row
each, this gives the state at each one's beginning. Then every range finds the entries that begin in it, and reads on to the end of the last one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .archives import opened
from .store import hadoop_path, new_folder

#: Bytes of a range, and by how much a task first reads on behind it.
RANGE, AHEAD = 8 << 20, 1 << 16
QUOTE, COMMA, COLON, BACKSLASH = b'",:\\'
STATES = "id long, quotes long, outside long, inside long"
ENTRIES = "id long, nth int, top string, key string, value string"


def _bytes(f: IO[bytes], start: int, end: int) -> np.ndarray:
    f.seek(start)
    return np.frombuffer(f.read(end - start), dtype=np.uint8)


def _backslashes(f: IO[bytes], start: int) -> int:
    """How many backslashes stand right before a place."""
    n = 0
    while n < start:
        back = min(start - n, 1024)
        piece = _bytes(f, start - n - back, start - n)
        other = np.flatnonzero(piece[::-1] != BACKSLASH)
        if len(other):
            return n + int(other[0])
        n += back
    return n


def _quotes(data: np.ndarray, before: int) -> np.ndarray:
    """Places of the quotes that no backslash escapes; before: backslashes that stand before data."""
    places = np.flatnonzero(data == QUOTE)
    last = np.flatnonzero(data != BACKSLASH)  # what a run of backslashes begins behind
    k = np.searchsorted(last, places) - 1
    run = np.where(k >= 0, places - 1 - last[np.maximum(k, 0)], places + before) if len(last) else places + before
    return places[run % 2 == 0]


def _braces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of braces and brackets, and 1 or -1 for each."""
    up, down = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
    at = np.flatnonzero(up | down)
    return at, np.where(up[at], 1, -1)


def state_change(data: np.ndarray, before: int) -> tuple[int, int, int]:
    """Unescaped quotes, and the change of depth if data begins outside a string, or inside one."""
    quotes = _quotes(data, before)
    at, step = _braces(data)
    odd = np.searchsorted(quotes, at) % 2 == 1
    return len(quotes), int(step[~odd].sum()), int(step[odd].sum())


def _next(places: np.ndarray, at: int) -> int:
    """The first of some places behind one, or -1."""
    k = int(np.searchsorted(places, at, side="right"))
    return int(places[k]) if k < len(places) else -1


def entries_in(f: IO[bytes], start: int, end: int, size: int, in_string: bool, depth: int, ahead: int = AHEAD) -> list[tuple[str | None, str | None, str | None]]:
    """(top, key, value) of the entries that begin between start and end, two levels deep; top is the outer key, None if it began earlier. Outer keys
    themselves are (top, None, None)."""
    before = _backslashes(f, start)
    while True:
        data = _bytes(f, start, min(size, end + ahead))
        whole = start + len(data) >= size
        quotes = _quotes(data, before)
        braces, step = _braces(data)
        outside = (np.searchsorted(quotes, braces) + in_string) % 2 == 0
        braces, step = braces[outside], step[outside]
        after = depth + np.cumsum(step)
        deep = lambda places: np.where((k := np.searchsorted(braces, places)) > 0, after[np.maximum(k - 1, 0)], depth) if len(braces) else np.full(len(places), depth)
        free = lambda places: places[(np.searchsorted(quotes, places) + in_string) % 2 == 0]
        colons, commas = free(np.flatnonzero(data == COLON)), free(np.flatnonzero(data == COMMA))
        colon_depth = deep(colons)
        ends = np.union1d(commas[deep(commas) == 2], braces[(step < 0) & (after == 1)])
        opening = quotes[int(in_string) :: 2]
        opening_depth = deep(opening)
        mine = opening[(opening < end - start) & (opening_depth <= 2)]
        if len(mine) and not whole:
            last = int(mine[-1])
            stop = _next(ends, last) if opening_depth[np.searchsorted(opening, last)] == 2 else _next(np.union1d(colons, np.union1d(commas, braces)), last)
            if stop < 0:
                ahead *= 4
                continue
        break
    text = data.tobytes()
    out = []
    top = None
    for colon, level in zip(colons.tolist(), colon_depth.tolist(), strict=True):
        k = int(np.searchsorted(quotes, colon))
        first = k - 2
        if level > 2 or first < 0 or quotes[first] >= end - start or (first + in_string) % 2:
            continue
        key = json.loads(text[quotes[first] : quotes[first + 1] + 1])
        if level == 1:
            top = key
            out.append((top, None, None))
        elif level == 2 and (stop := _next(ends, colon)) >= 0:
            out.append((top, key, text[colon + 1 : stop].decode("utf-8", "replace")))
    return out


def read_entries(spark: SparkSession, path: str, step: int = RANGE) -> DataFrame | None:
    """top, key and value (JSON text) of each entry of the objects in a file's outer object; None if quotes or braces don't match up.

    The file is read twice, once for the states and once for the entries, which are written to the shared folder. Of a key that repeats each entry is given.
    """
    fs, at = hadoop_path(spark, path)
    size = fs.getFileStatus(at).getLen()
    if not size:
        return None
    n = -(-size // step)
    ids = spark.range(0, n, 1, min(n, 4 * spark.sparkContext.defaultParallelism))

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as f:
            for b in batches:
                rows = [(i, *state_change(_bytes(f, i * step, min(size, (i + 1) * step)), _backslashes(f, i * step))) for i in b["id"].tolist()]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])

    folder = new_folder(spark, "states")
    ids.mapInPandas(states, STATES).write.parquet(folder)
    earlier = W.orderBy("id").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    known = spark.read.schema(STATES).parquet(folder).withColumn("in_string", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    known = known.withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    known = known.select("id", "in_string", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"), "quotes", "change")
    whole = known.agg(F.sum("quotes") % 2 == 0, F.sum("change") == 0, F.min("depth") >= 0).first()
    if not all(whole):
        return None

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with opened(path) as f:
            for b in batches:
                for i, in_string, depth in zip(b["id"].tolist(), b["in_string"].tolist(), b["depth"].tolist(), strict=True):
                    rows = entries_in(f, i * step, min(size, (i + 1) * step), size, in_string, depth)
                    yield pd.DataFrame([(i, k, *r) for k, r in enumerate(rows)], columns=[c.split()[0] for c in ENTRIES.split(", ")])

    folder = new_folder(spark, "entries")
    known.select("id", "in_string", "depth").repartition(min(n, 4 * spark.sparkContext.defaultParallelism), "id").mapInPandas(entries, ENTRIES).write.parquet(folder)
    found = spark.read.schema(ENTRIES).parquet(folder)
    tops = found.filter("key is null").groupBy("id").agg(F.max_by("top", "nth").alias("top"))
    tops = spark.range(n).join(tops, "id", "left").select("id", F.last("top", ignorenulls=True).over(earlier).alias("open"))
    # one row a range
    return found.filter("key is not null").join(F.broadcast(tops), "id").select(F.coalesce("top", "open").alias("top"), "key", "value")
