"""Operator 5: exact top-k inner products by best-first search in an M-tree.

Inner products become distances: with M the largest length of a vector, v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0) give
|q' - v'|^2 = |q|^2 + M^2 - 2 q.v, so the nearest vectors are those of the largest product. The tree's depth grows with the table: a node of
more than 2 NODE vectors gets up to FAN children around routing objects that lie far from each other in a bounded sample of the node, and
each vector goes to the nearest one; vectors that are all alike are split by a hash. Every routing object keeps its covering radius, and its
distance to its parent. A leaf is one row of pages, with routing objects of their own; an entry keeps its distance to its page's.

Queries are searched in blocks, in waves. First each meets its own leaf, which gives it a distance that its results can't exceed. With it
the queries go down the tree; children out of reach, by the parent's distance or their own, are left out. Of the leaves that are left each
query meets the nearest few, and with the better distance the others that it still reaches. In a leaf the pages are visited from the nearest on, and
pages and entries that the triangle inequality over the stored distances rules out are left out. All values are integers below 2^53, and
bounds have a margin for the rounding of square roots, so results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import written

K = 20
EVERY = 20
SCALE = 64
#: Vectors of a leaf and of a page, queries of a block, and blocks that one task takes to a node.
NODE, PAGE, BLOCK, CHUNK = 1024, 64, 256, 16
#: Children of a node at most, and vectors of the sample for each that routing objects are chosen from.
FAN, SAMPLE = 256, 16
#: Levels at most; leaves that are still too large by then stay so.
LEVELS = 7
#: Leaves that a query meets, after its own, before its bound is taken anew.
WAVE = 4
#: Added to distances before something is ruled out.
MARGIN = 1e-6


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floor of each scaled component. Rows with a null id, and vectors that are null or hold a null or
    non-finite component, are left out; shorter vectors end in zeros."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null")
    inf = float("inf")
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: in doubles where they surely fit, else in integers."""
    top = float(max(np.abs(a).max(initial=0), 1)) * float(max(np.abs(b).max(initial=0), 1)) * max(1, a.shape[1])
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def lengths(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)


def object_distances(a: np.ndarray, b: np.ndarray, m2: int) -> np.ndarray:
    """Distances between vectors of the tree, lifted to one more dimension."""
    la, lb = lengths(a), lengths(b)
    lift = np.sqrt(np.maximum(m2 - la, 0))[:, None] * np.sqrt(np.maximum(m2 - lb, 0))[None, :]
    d2 = (la[:, None] + lb[None, :] - 2 * products(a, b)).astype(np.float64) + (2 * m2 - la[:, None] - lb[None, :]) - 2 * lift
    return np.sqrt(np.maximum(d2, 0))


def query_distances(score: np.ndarray, lq: np.ndarray, m2: int) -> np.ndarray:
    """The distances of queries of squared length lq that belong to inner products."""
    return np.sqrt(np.maximum(lq + m2 - 2 * score, 0).astype(np.float64))


def limits(bound: np.ndarray, lq: np.ndarray, m2: int) -> np.ndarray:
    """The distances of bounds, beyond which nothing is wanted; no limit for LOWEST."""
    open_ = bound == LOWEST
    return np.where(open_, np.inf, query_distances(np.where(open_, 0, bound), lq, m2)) + MARGIN


def spread(x: np.ndarray, k: int, m2: int) -> np.ndarray:
    """k rows of x far from each other, as positions."""
    picked = [0]
    far = object_distances(x, x[:1], m2)[:, 0]
    while len(picked) < min(k, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, object_distances(x, x[picked[-1:]], m2)[:, 0])
    return np.array(picked)


def build_node(ids: np.ndarray, v: np.ndarray, m2: int, centre: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Pages of vectors around routing objects: rows in page order, where pages end, radii, the entries' distances to their page's object, and
    those of the pages' objects to the node's (the first vector, unless given)."""
    centre = v[:1] if centre is None else centre
    centres = v[spread(v, math.ceil(len(v) / PAGE), m2)]
    d = object_distances(v, centres, m2)
    own = d.argmin(axis=1)
    near = d[np.arange(len(v)), own]
    order = np.lexsort((ids, own))
    sizes = np.bincount(own, minlength=len(centres))
    radius = np.zeros(len(centres))
    np.maximum.at(radius, own, near)
    return {"ids": ids[order], "v": v[order], "ends": np.cumsum(sizes), "centres": centres, "radius": radius, "near": near[order], "centre": centre, "to_parent": object_distances(centres, centre, m2)[:, 0]}


def search_node(node: dict[str, np.ndarray], qids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, m2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, id) of the node's best k vectors for each query that aren't farther than the query's bound.

    bound: squared-length-free: the least score that is wanted, or the smallest integer. Ids equal to the query's don't count.
    """
    lq = lengths(q)
    least = bound.copy()
    limit = limits(least, lq, m2)
    # pages that the stored distances to the node's object rule out need no distance of their own
    to_node = query_distances(products(q, node["centre"]), lq[:, None], m2)
    maybe = np.flatnonzero((np.abs(to_node - node["to_parent"]) - node["radius"] - MARGIN <= limit[:, None]).any(axis=0))
    to_centre = np.full((len(q), len(node["radius"])), np.inf)
    to_centre[:, maybe] = query_distances(products(q, node["centres"][maybe]), lq[:, None], m2)
    reach = to_centre - node["radius"] - MARGIN
    best_s = np.full((len(q), k), LOWEST)
    best_i = np.full((len(q), k), HIGHEST)
    starts = np.concatenate([[0], node["ends"][:-1]])
    for page in maybe[reach[:, maybe].min(axis=0).argsort(kind="stable")]:
        use = np.flatnonzero(reach[:, page] <= limit)
        lo, hi = starts[page], node["ends"][page]
        if not len(use) or lo == hi:
            continue
        # triangle inequality: |d(query, centre) - d(entry, centre)| bounds the distance from below
        possible = np.abs(to_centre[use, page, None] - node["near"][None, lo:hi]) <= limit[use, None] + MARGIN
        entries = np.flatnonzero(possible.any(axis=0))
        if not len(entries):
            continue
        ids = node["ids"][lo:hi][entries]
        s = products(q[use], node["v"][lo:hi][entries])
        fits = possible[:, entries] & (s >= least[use, None]) & (ids[None, :] != qids[use, None])
        alls = np.concatenate([best_s[use], np.where(fits, s, LOWEST)], axis=1)
        alli = np.concatenate([best_i[use], np.where(fits, ids[None, :], HIGHEST)], axis=1)
        order = np.lexsort((alli, -alls), axis=1)[:, :k]
        best_s[use], best_i[use] = np.take_along_axis(alls, order, 1), np.take_along_axis(alli, order, 1)
        least[use] = np.maximum(least[use], best_s[use, -1])
        limit[use] = limits(least[use], lq[use], m2)
    at, col = np.nonzero(best_s != LOWEST)
    return at, best_s[at, col], best_i[at, col]


LOWEST, HIGHEST = -(1 << 62), (1 << 62)

#: A leaf, and the children of an inner node (ids, routing objects, distances to the parent's, radii); arrays as bytes.
LEAF = "node long, n int, ids binary, v binary, ends binary, centres binary, radius binary, near binary, centre binary, to_parent binary"
INNER = "node long, ids binary, centres binary, to_parent binary, radius binary"
DOUBLES = ("radius", "near", "to_parent")
FOUND = "query_id long, q long, vec_id long, score long"
REACHED = "vec_id long, v array<long>, q long, lq long, bound long, node long, d double, least double"


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, dtype=np.float64 if x.dtype.kind == "f" else np.int64).tobytes()


def _unpacked(row: dict, dim: int) -> dict[str, np.ndarray]:
    out = {x: np.frombuffer(b, np.float64 if x in DOUBLES else np.int64) for x, b in row.items() if isinstance(b, bytes)}
    return out | {x: out[x].reshape(-1, dim) for x in ("v", "centres", "centre") if x in out}


def _matrix(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), dtype=np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _split(large: DataFrame, dim: int, m2: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One more level for nodes that are too large: rows (vec_id, v, node, near) of large with the child that each goes to, and the children
    (parent, place, node, centre, to_parent). large has the column n, the rows of the node, and centre, its routing object (null at the root)."""
    wanted = F.least(F.lit(FAN), F.ceil(F.col("n") / NODE)).cast("int")
    # the row's own number takes part, so that of rows that repeat some are chosen and not all or none
    place = (F.xxhash64(F.lit(level), "vec_id", F.monotonically_increasing_id()).cast("double") / float(1 << 63) + 1) / 2
    sample = large.withColumn("wanted", wanted).filter(place <= 2.0 * SAMPLE * F.col("wanted") / F.col("n") + 1e-9)

    def objects(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x, k = _matrix(list(pdf["v"]), dim), int(pdf["wanted"].iloc[0])
        centres = x[spread(x, k, m2)]
        if len(centres) < k:  # too few different ones: they repeat, and a hash decides between equal ones
            centres = np.resize(centres, (k, dim))
        parent = pdf["centre"].iloc[0]
        far = object_distances(centres, np.frombuffer(parent, np.int64).reshape(1, dim), m2)[:, 0] if parent is not None else np.zeros(len(centres))
        return pd.DataFrame([{"parent": pdf["node"].iloc[0], "centres": _pack(centres), "to_parent": _pack(far)}])

    # a bounded number of rows of each node meets in a task
    children = written(sample.groupBy("node").applyInPandas(objects, "parent long, centres binary, to_parent binary"), "children")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                x, nodes = _matrix(part.column("v").to_pylist(), dim), part.column("node").to_numpy()
                own, near = np.zeros(len(x), np.int64), np.zeros(len(x))
                packed = part.column("centres")
                for node in np.unique(nodes):
                    rows = np.flatnonzero(nodes == node)
                    centres = np.frombuffer(packed[int(rows[0])].as_py(), np.int64).reshape(-1, dim)
                    again = np.flatnonzero((centres[1:] == centres[0]).all(axis=1))
                    different = int(again[0]) + 1 if len(again) else len(centres)
                    d = object_distances(x[rows], centres[:different], m2)
                    first = d.argmin(axis=1)
                    near[rows] = d[np.arange(len(rows)), first]
                    own[rows] = first + different * (part.column("h").to_numpy()[rows] % ((len(centres) - 1 - first) // different + 1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(nodes * (FAN + 1) + own + 1), pa.array(near)], names=["vec_id", "v", "node", "near"])

    # a node's objects are small beside its vectors, but there may be many nodes, so they are joined and not broadcast by hand
    meets = large.select("vec_id", "v", "node", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(1 << 30)).alias("h")).join(children.select(F.col("parent").alias("node"), "centres"), "node")
    placed = written(meets.mapInArrow(assign, "vec_id long, v array<long>, node long, near double"), "placed")
    return placed, children


def _singles(children: DataFrame, dim: int) -> DataFrame:
    """parent, node, centre and to_parent of each child."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                far = np.frombuffer(r["to_parent"], np.float64)
                centres = np.frombuffer(r["centres"], np.int64).reshape(-1, dim)
                ids = r["parent"] * (FAN + 1) + 1 + np.arange(len(far))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(far), r["parent"])), pa.array(ids), pa.array([_pack(c) for c in centres], pa.binary()), pa.array(far)], names=["parent", "node", "centre", "to_parent"])

    return children.mapInArrow(run, "parent long, node long, centre binary, to_parent double")


def grow(v: DataFrame, n: int, dim: int, m2: int) -> tuple[DataFrame, DataFrame, int]:
    """The tree over rows (vec_id, v): rows with their leaf and its routing object, inner nodes, and the number of levels."""
    open_ = v.withColumns({"node": F.lit(0).cast("long"), "centre": F.lit(None).cast("binary"), "n": F.lit(max(1, n)).cast("long")})
    leaves, inner = [], []
    for level in range(1, LEVELS + 1):
        placed, children = _split(open_, dim, m2, level)
        stats = placed.groupBy("node").agg(F.count("*").alias("n"), F.max("near").alias("radius"))
        nodes = written(_singles(children, dim).join(stats, "node"), "nodes")
        packed = F.array_sort(F.collect_list(F.struct("node", "centre", "to_parent", "radius")))  # FAN children at most
        inner.append(nodes.groupBy(F.col("parent").alias("node")).agg(packed.alias("kids")))
        small = (F.col("n") <= 2 * NODE) if level < LEVELS else F.lit(True)
        leaves.append(placed.join(nodes.filter(small).select("node", "centre"), "node").select("vec_id", "v", "node", "centre"))
        if level == LEVELS or nodes.filter(~small).isEmpty():
            break
        open_ = placed.join(nodes.filter(~small).select("node", "centre", "n"), "node").select("vec_id", "v", "node", "centre", "n")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                kids = r["kids"]
                values = [[r["node"]], [_pack(np.array([k["node"] for k in kids]))], [b"".join(k["centre"] for k in kids)], [_pack(np.array([k["to_parent"] for k in kids]))], [_pack(np.array([k["radius"] for k in kids]))]]
                yield pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), *(pa.array(x, pa.binary()) for x in values[1:])], names=[c.split()[0] for c in INNER.split(", ")])

    return written(reduce(DataFrame.union, leaves), "leaves"), written(reduce(DataFrame.union, inner).mapInArrow(pack, INNER), "inner"), level


def _met(asked: DataFrame, nodes: DataFrame, blocks: int, run, schema: str) -> DataFrame:
    """What run gives for blocks of queries beside the node that they are sent to.

    asked: node and the columns of a query. Queries are dealt to blocks by their ids, and a node is met by CHUNK blocks in a task, so a node that
    all queries meet is spread over tasks; what a node's row holds is bounded.
    """
    columns = [c for c in asked.columns if c != "node"]
    block = F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks))
    grouped = asked.groupBy("node", (block / CHUNK).cast("int").alias("chunk"), block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias("queries"))
    grouped = written(grouped, "asked")
    dealt = nodes.join(grouped.select("node", "chunk").distinct(), "node").join(grouped.drop("block"), ["node", "chunk"])
    return dealt.drop("chunk").mapInArrow(run, schema)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest products for each row whose id is divisible by every.

    Ties go to the smaller vec_id. Queries with fewer than k other rows get them all; an empty table gives none. Rows that
    repeat a vec_id are candidates of their own, but never of that id's query, which runs once for each different vector of the id. Null
    ids and vectors, and those with a null or non-finite component, take no part; other columns are ignored.
    """
    v = written(integers(vectors, scale), "vectors")
    size = v.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))).first()
    n, dim, m2 = size[0], max(1, size[1] or 0), size[2] or 0
    leaves, inner, levels = grow(v, n, dim, m2)
    blocks = max(1, math.ceil(n / every / BLOCK))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = np.frombuffer(pdf["centre"].iloc[0], np.int64).reshape(1, dim)
        node = build_node(pdf["vec_id"].to_numpy(), _matrix(list(pdf["v"]), dim), m2, centre)
        return pd.DataFrame([{"node": pdf["node"].iloc[0], "n": len(pdf), **{x: _pack(a) for x, a in node.items()}}])

    nodes = written(leaves.groupBy("node").applyInPandas(build, LEAF), "nodes")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a row holds a whole leaf
                row = b.slice(i, 1).to_pylist()[0]
                asked = row["queries"]
                qids = np.array([x["vec_id"] for x in asked])
                bound = np.array([LOWEST if x["bound"] is None else x["bound"] for x in asked])
                at, s, ids = search_node(_unpacked(row, dim), qids, _matrix([x["v"] for x in asked], dim), bound, k, m2)
                yield pa.RecordBatch.from_arrays([pa.array(qids[at], pa.int64()), pa.array([asked[j]["q"] for j in at], pa.int64()), pa.array(ids, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "q", "vec_id", "score"])

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                kids, asked = _unpacked(row, dim), row["queries"]
                q = _matrix([x["v"] for x in asked], dim)
                lq = lengths(q)
                limit = limits(np.array([LOWEST if x["bound"] is None else x["bound"] for x in asked]), lq, m2)
                above = np.array([np.nan if x["d"] is None else x["d"] for x in asked])
                maybe = np.flatnonzero(~(np.abs(above[:, None] - kids["to_parent"]) - kids["radius"] - MARGIN > limit[:, None]).all(axis=0))
                d = query_distances(products(q, kids["centres"][maybe]), lq[:, None], m2)
                least = d - kids["radius"][maybe] - MARGIN
                at, kid = np.nonzero(least <= limit[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([asked[j]["vec_id"] for j in at], pa.int64()), pa.array([asked[j]["v"] for j in at], pa.list_(pa.int64())), pa.array([asked[j]["q"] for j in at], pa.int64()), pa.array(lq[at], pa.int64()),
                        pa.array([asked[j]["bound"] for j in at], pa.int64()), pa.array(kids["ids"][maybe][kid], pa.int64()), pa.array(d[at, kid]), pa.array(least[at, kid]),
                    ],
                    names=[c.split()[0] for c in REACHED.split(", ")],
                )

    best = W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    kth = lambda found: ranked(found).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "q", F.col("score").alias("bound"))

    queries = leaves.filter(F.col("vec_id") % every == 0).select("vec_id", "v", F.xxhash64("v").alias("q"), F.col("node").alias("home")).dropDuplicates(["vec_id", "q"])
    queries = written(queries, "queries")
    first = written(_met(queries.select("vec_id", "v", "q", F.lit(None).cast("long").alias("bound"), F.col("home").alias("node")), nodes, blocks, search, FOUND), "first")

    down = queries.join(kth(first), ["vec_id", "q"], "left").select("vec_id", "v", "q", "bound", F.lit(0).cast("long").alias("node"), F.lit(None).cast("double").alias("d"))
    reached = []
    for _ in range(levels):
        below = written(_met(down, inner, blocks, descend, REACHED), "reached")
        reached.append(below.join(inner.select("node"), "node", "left_anti").select("vec_id", "v", "q", "lq", "bound", "node", "least"))
        down = below.join(inner.select("node"), "node", "left_semi").select("vec_id", "v", "q", "bound", "node", "d")
    others = reduce(DataFrame.union, reached).join(queries.select("vec_id", "q", "home"), ["vec_id", "q"]).filter(F.col("node") != F.col("home"))
    turn = F.row_number().over(W.partitionBy("vec_id", "q").orderBy("least", "node"))
    others = written(others.withColumn("turn", turn), "others")
    second = written(_met(others.filter(F.col("turn") <= WAVE).select("vec_id", "v", "q", "bound", "node"), nodes, blocks, search, FOUND), "second")

    better = kth(first.union(second))
    rest = others.filter(F.col("turn") > WAVE).drop("bound").join(better, ["vec_id", "q"], "left")
    limit = F.sqrt(F.greatest(F.lit(0), F.col("lq") + m2 - 2 * F.col("bound")).cast("double")) + MARGIN
    rest = rest.filter(F.col("bound").isNull() | (F.col("least") <= limit)).select("vec_id", "v", "q", "bound", "node")
    third = _met(rest, nodes, blocks, search, FOUND)
    out = ranked(first.union(second).union(third))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: DuckDB: every query against every row.
ORACLE = f"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {SCALE}) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % {EVERY} = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {K}
"""
