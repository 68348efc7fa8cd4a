"""Operator 11: the trie of conversation prefixes, by the Euler-tour technique.

Conversations that begin with the same turns share nodes. Each node has an arc in and an arc out; an arc's successor is the arc into the first
child, into the next sibling, or out of the parent. The list of arcs is ranked: each arc gets its position in the tour and the sums of weights
before it, so what lies in a subtree is the difference between the sums at its two arcs.

Ranking is distributed: arcs are numbered by their node's conversation and depth, in which order most of the tour runs straight on, and cut
into blocks of equal size. Inside a block pointers are doubled until they leave it; what is left is a list of the runs between
such exits, which is numbered and cut anew. Where that doesn't shorten the list by a quarter, as exits may lie anywhere, runs are merged with their
predecessor by coin flips, which does so in expectation. When one block holds the list, its places are final and go back level by level.

A prefix is known by its depth and by two 64-bit sums (exclusive or) of hashes of its turns with their places, which grow with each turn and so need
no text; they are taken for the sequence itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import joined_with_hot, number_rows, written

#: Every conversation takes its first turns, fewer than HEADS, from the one FAMILY-th below it.
FAMILY, HEADS = 5, 9
#: Turns of a conversation that are summed up in a row; the sums of such runs are summed up again.
RUN = 4096
#: Arcs that a task ranks at a time.
BLOCK = 1 << 13
#: Children of a node, or turns of a conversation, from which facts about it are sent to every task, and such nodes at most.
HOT, MOST_HOT = 10_000, 200_000
#: Characters of joined ids that travel as one value.
PIECE = 1 << 15

LEVEL = "id long, into long, at long, leaves long, saved long"
LIST = ["id", "next", "n", "leaves", "saved"]


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with their place from 1 on (conv_id, pos, x1, x2, bytes), and conversations (conv_id, turns). Texts end here, as hashes."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    hashed = [F.xxhash64(F.lit(seed), role, F.octet_length(role), text).alias(f"x{seed}") for seed in (1, 2)]
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *hashed, F.octet_length(text).cast("long").alias("bytes"))
    rows = number_rows(rows, ["conv_id", "turn", "x1", "x2"], "row")
    convs = written(rows.groupBy("conv_id").agg(F.min("row").alias("first"), F.count("*").alias("turns")), "convs")
    placed = joined_with_hot(rows, convs.select("conv_id", "first", "turns"), ["conv_id"], "turns", HOT, MOST_HOT)
    return placed.select("conv_id", (F.col("row") - F.col("first") + 1).alias("pos"), "x1", "x2", "bytes"), convs.select("conv_id", "turns")


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, d (from 1), x1, x2, bytes of each rebuilt turn, and conv_id and length of each rebuilt conversation."""
    turns, convs = _turns(conversations)
    turns = written(turns, "turns")
    base = convs.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(base, "base", "left")
    # a conversation that is its own base stays as it is
    heads = F.when(F.col("base") == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = convs.withColumn("h", heads).withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))), "rebuilt")

    head = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base")
    head = head.join(convs.filter("taken > 0").select("base", "conv_id", "taken"), "base").filter("pos <= taken").select("conv_id", F.col("pos").alias("d"), "x1", "x2", "bytes")
    tail = joined_with_hot(turns, convs.select("conv_id", "h", "taken", "turns"), ["conv_id"], "turns", HOT, MOST_HOT).filter("pos > h")
    tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "x1", "x2", "bytes")
    return head.union(tail), convs.select("conv_id", "length")


def _prefixes(turns: DataFrame) -> DataFrame:
    """turns with k1, k2 (the prefix up to and with each turn) and p1, p2 (without it)."""
    for s in "12":
        turns = turns.withColumn(f"x{s}", F.xxhash64("d", f"x{s}"))
    turns = turns.withColumn("run", F.expr(f"d div {RUN}"))
    here = W.partitionBy("conv_id", "run").orderBy("d").rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = turns.groupBy("conv_id", "run").agg(F.bit_xor("x1").alias("r1"), F.bit_xor("x2").alias("r2"))
    earlier = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", *(F.coalesce(F.bit_xor(f"r{s}").over(earlier), F.lit(0)).alias(f"r{s}") for s in "12"))
    sums = turns.select("*", *(F.bit_xor(f"x{s}").over(here).alias(f"k{s}") for s in "12")).join(runs, ["conv_id", "run"])
    for s in "12":
        sums = sums.withColumn(f"k{s}", F.col(f"k{s}").bitwiseXOR(F.col(f"r{s}"))).withColumn(f"p{s}", F.col(f"k{s}").bitwiseXOR(F.col(f"x{s}")))
    return sums.select("conv_id", "d", "k1", "k2", "p1", "p2", "bytes")


def _nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """row, conv_id, depth, k1, k2, n_convs, weight, n_children, first_child, parent and parent_conv_id of every node, numbered by conv_id and depth."""
    nodes = prefixes.groupBy("k1", "k2", F.col("d").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("p1", "p2", "bytes")))
    zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth")]
    root = convs.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*zero, "conv_id", "n_convs", F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), F.lit(0).cast("long").alias("bytes"))
    nodes = nodes.withColumn("depth", F.col("depth").cast("long")).select(root.columns).union(root)
    nodes = written(number_rows(nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("bytes")), ["conv_id", "depth"], "row"), "nodes")
    at = ["k1", "k2", "depth"]
    children = nodes.filter("depth > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"), F.col("row"))
    families = children.groupBy(*at).agg(F.count("*").alias("n_children"), F.min("row").alias("first_child"))
    nodes = written(nodes.join(families, at, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "families")
    parents = nodes.filter("n_children > 0").select(*at, F.col("row").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    parents = joined_with_hot(children, written(parents, "parents"), at, "n_children", HOT, MOST_HOT).select("row", "parent", "parent_conv_id")
    return written(nodes.join(parents, "row", "left"), "trie")


def _tour(nodes: DataFrame) -> DataFrame:
    """The list of arcs: id (twice the node's row, one more for the way out), next (-1 at the end) and the weights n, leaves and saved."""
    children = nodes.filter("parent is not null").select("row", "parent")
    ordered = number_rows(children, ["parent", "row"], "place")  # siblings stand in a row, however many
    ordered = written(ordered, "siblings")
    later = ordered.select((F.col("place") - 1).alias("place"), F.col("parent").alias("of"), F.col("row").alias("sibling"))
    sibling = ordered.join(later, "place").filter("parent = of").select("row", "sibling")
    nodes = nodes.join(sibling, "row", "left")
    leaf = F.col("n_children") == 0
    into = F.struct((2 * F.col("row")).alias("id"), F.when(leaf, 2 * F.col("row") + 1).otherwise(2 * F.col("first_child")).alias("next"), leaf.cast("long").alias("leaves"), F.col("weight").alias("saved"))
    out = F.when(F.col("sibling").isNotNull(), 2 * F.col("sibling")).otherwise(F.coalesce(2 * F.col("parent") + 1, F.lit(-1)))
    out = F.struct((2 * F.col("row") + 1).alias("id"), out.alias("next"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    return nodes.select(F.explode(F.array(into, out)).alias("a")).select("a.id", "a.next", F.lit(1).cast("long").alias("n"), "a.leaves", "a.saved")


def rank_block(ids: np.ndarray, following: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first element of each element's run, the weights before it in the run, and for each element the last one of its run.

    ids are distinct, following holds those of the successors, and weights a row for each element. A run ends where its successor isn't among the ids.
    Pointers are doubled, so rounds grow with the logarithm of the longest run.
    """
    order = np.argsort(ids)
    found = np.minimum(np.searchsorted(ids, following, sorter=order), len(ids) - 1)
    inside = ids[order[found]] == following
    before = np.full(len(ids), -1)  # predecessor in the block
    before[order[found[inside]]] = np.flatnonzero(inside)
    own = np.arange(len(ids))
    first = np.where(before < 0, own, before)
    sums = np.where((before < 0)[:, None], 0, weights[first])
    while (further := first[first]).tolist() != first.tolist():
        first, sums = further, sums + sums[first]
    last = own.copy()
    last[first[~inside]] = np.flatnonzero(~inside)
    return first, sums, last[first]


def _contracted(items: DataFrame, block: int) -> DataFrame:
    """Items (id, next and weights, with block) with the run that they are in, by its first element, and what lies before them in it; first elements also
    carry their run's successor and weights."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, following = rows["id"].to_numpy(), rows["next"].to_numpy()
        weights = rows[["n", "leaves", "saved"]].to_numpy()
        first, sums, last = rank_block(ids, following, weights)
        heads = first == np.arange(len(ids))
        whole = sums[last] + weights[last]
        out = pd.DataFrame({"id": ids, "into": ids[first], "at": sums[:, 0], "leaves": sums[:, 1], "saved": sums[:, 2]})
        for k, c in enumerate(("run_n", "run_leaves", "run_saved")):
            out[c] = np.where(heads, whole[:, k], 0)
        return out.assign(run_next=following[last])

    dealt = items.withColumn("block", F.expr(f"place div {block}"))
    return dealt.groupBy("block").applyInPandas(run, f"{LEVEL}, run_n long, run_leaves long, run_saved long, run_next long")


def _merged(items: DataFrame, salt: int) -> DataFrame:
    """The same, where each element whose coin shows tails joins its predecessor if that shows heads."""
    tails = lambda c: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(2)) == 1
    own = items.select(*LIST, tails(F.col("id")).alias("tails"))
    ahead = own.filter("not tails").select(F.col("next").alias("id"), F.col("id").alias("into"), *(F.col(c).alias(f"b_{c}") for c in LIST[2:]))
    behind = own.filter("tails").select(F.col("id").alias("next"), F.col("next").alias("c_next"), *(F.col(c).alias(f"c_{c}") for c in LIST[2:]))
    joins = own.join(ahead, "id", "left").withColumn("joins", F.col("tails") & F.col("into").isNotNull())
    zero = F.lit(0).cast("long")
    joins = joins.withColumn("into", F.when(F.col("joins"), F.col("into")).otherwise(F.col("id")))
    for c in LIST[2:]:
        joins = joins.withColumn(f"b_{c}", F.when(F.col("joins"), F.col(f"b_{c}")).otherwise(zero))
    out = joins.join(behind, "next", "left")
    gains = F.col("c_n").isNotNull() & ~F.col("tails")
    total = [(F.col(c) + F.when(gains, F.col(f"c_{c}")).otherwise(zero)).alias(f"run_{c}") for c in LIST[2:]]
    return out.select("id", "into", F.col("b_n").alias("at"), F.col("b_leaves").alias("leaves"), F.col("b_saved").alias("saved"), *total, F.when(gains, F.col("c_next")).otherwise(F.col("next")).alias("run_next"))


def ranked(items: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, at, leaves and saved for each element of a list (id, next, n, leaves, saved): the sums of the weights before it.

    next is -1 at the end of the list; a list has one beginning and one end. No task holds more than a block. The order of ids should be near
    that of the list, for few rounds; any order gives the same result.
    """
    levels: list[DataFrame] = []
    items = written(items.withColumn("place", F.col("id")), "list")  # ids of the first level are dense
    size = items.count()
    shrank = True
    while True:
        level = _contracted(items, block) if shrank else _merged(items, len(levels))
        level = written(level, "level")
        runs = level.filter("id = into")
        left = runs.count()
        levels.append(level)
        if left <= 1:
            break
        shrank = left <= size * 3 // 4 or not shrank
        size = left
        items = runs.select("id", F.col("run_next").alias("next"), F.col("run_n").alias("n"), F.col("run_leaves").alias("leaves"), F.col("run_saved").alias("saved"))
        items = number_rows(items, ["id"], "place")
    known = levels.pop().select("id", "at", "leaves", "saved")
    while levels:
        before = known.select(F.col("id").alias("into"), *(F.col(c).alias(f"_{c}") for c in ("at", "leaves", "saved")))
        joined = levels.pop().select("id", "into", "at", "leaves", "saved").join(before, "into")
        known = written(joined.select("id", *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("at", "leaves", "saved"))), "ranks")
    return known


def _ends(ends: DataFrame) -> DataFrame:
    """k1, k2, depth and ends_sha256 for each node at which a rebuilt conversation ends. ends: k1, k2, depth, conv_id.

    Ids are sorted over all tasks and joined in pieces as they come; a node with several pieces is hashed piece by piece, so that memory
    holds one of them, however many conversations are the same.
    """
    at = ["k1", "k2", "depth"]
    schema = "k1 long, k2 long, depth long, first long, ids string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, ids, size = None, 0, [], 0
        out: list[tuple] = []
        for b in batches:
            for k1, k2, depth, conv_id in zip(*(b.column(c).to_pylist() for c in (*at, "conv_id")), strict=True):
                if (k1, k2, depth) != now or size > PIECE:
                    if now:
                        out.append((*now, first, ",".join(ids)))
                    now, first, ids, size = (k1, k2, depth), conv_id, [], 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "depth", "first", "ids"), r, strict=True)) for r in out], kind)
                out = []
        if now:
            out.append((*now, first, ",".join(ids)))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("k1", "k2", "depth", "first", "ids"), r, strict=True)) for r in out], kind)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out: list[dict] = []
            for k1, k2, depth, ids in zip(*(b.column(c).to_pylist() for c in (*at, "ids")), strict=True):
                if (k1, k2, depth) != now:
                    if now:
                        out.append(dict(zip((*at, "ends_sha256"), (*now, sha.hexdigest()), strict=True)))
                    now, sha = (k1, k2, depth), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, done)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip((*at, "ends_sha256"), (*now, sha.hexdigest()), strict=True))], done)

    kind = pa.schema([(c, pa.int64()) for c in (*at, "first")] + [("ids", pa.string())])
    done = pa.schema([(c, pa.int64()) for c in at] + [("ends_sha256", pa.string())])
    pieces = written(ends.repartitionByRange(*at, "conv_id").sortWithinPartitions(*at, "conv_id").mapInArrow(join, schema), "pieces")
    return pieces.repartition(*at).sortWithinPartitions(*at, "first").mapInArrow(digest, "k1 long, k2 long, depth long, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at and exit_at for each node.

    Rows without a conv_id are ignored. Turns are ordered with a null turn first; rows that tie in it, repeated ones too, follow each
    other in the order of a hash of role and text, and each counts. Null roles and texts are empty; texts count whole, by their hash. A node is
    named by its smallest member and its depth; enter_at and exit_at are the places of its arcs in the tour. Columns of other names are ignored; an
    empty table gives no node, not even the root.
    """
    turns, convs = _rebuilt(conversations)
    prefixes = written(_prefixes(turns), "prefixes")
    nodes = _nodes(prefixes, convs)
    sums = ranked(_tour(nodes), block)
    part = lambda c, way: F.max(F.when(F.col("id") % 2 == way, F.col(c)))
    inside = lambda c: (part(c, 1) - part(c, 0)).alias(c)
    sums = sums.groupBy(F.expr("id div 2").alias("row")).agg(inside("leaves"), inside("saved"), part("at", 0).alias("enter_at"), part("at", 1).alias("exit_at"))
    at = ["k1", "k2", "depth"]
    last = prefixes.join(convs.select("conv_id", F.col("length").alias("d")), ["conv_id", "d"]).select("k1", "k2", F.col("d").cast("long").alias("depth"), "conv_id")
    zero = F.lit(0).cast("long")
    last = last.union(convs.filter("length = 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id"))
    out = nodes.join(sums, "row").join(_ends(last), at, "left")
    none: Column = F.sha2(F.lit("").cast("binary"), 256)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"), "enter_at", "exit_at",
    )


#: Ancestors of each node are the prefixes of its smallest member, so subtrees are a join on them. Places in the tour follow from the sizes of subtrees:
#: a node's arc in comes after its parent's and both arcs of all nodes below earlier siblings.
ORACLE = f"""
with tab as (select list(c order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
    from (select cast(range as bigint) as i from range(256)))),
convs as (select conv_id, count(*) as turns from conversations where conv_id is not null group by conv_id),
bytes as (select conv_id, turns, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: cast(unicode(c) as bigint)) as b from convs),
heads as (select conv_id, turns, conv_id - conv_id % {FAMILY} as base, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {HEADS} as h from bytes, tab),
t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
rebuilt as (select h.conv_id, t.pos as d, role, text from heads h join t on t.conv_id = h.base and t.pos <= h.h
    union all select h.conv_id, t.pos - h.h + least(h.h, coalesce(b.turns, 0)), role, text from heads h join t on t.conv_id = h.conv_id and t.pos > h.h left join convs b on b.conv_id = h.base),
paths as (select conv_id, d, text, list({{'role': role, 'text': text}}) over (partition by conv_id order by d) as path from rebuilt
    union all select conv_id, 0, '', cast([] as struct(role varchar, text varchar)[]) from convs),
ends as (select conv_id, max(d) as d from paths group by conv_id),
named as (select p.conv_id, p.d, p.text, min(p.conv_id) over (partition by p.path) as node from paths p),
nodes as (select node as conv_id, d as depth, count(*) as n_convs, (count(*) - 1) * coalesce(any_value(strlen(text)), 0) as w from named group by node, d),
members as (select n.node as conv_id, n.d as depth, string_agg(cast(n.conv_id as varchar), ',' order by n.conv_id) as ids from named n join ends e on n.conv_id = e.conv_id and n.d = e.d group by all),
above as (select x.conv_id, x.depth, n.node as top, n.d as top_depth from nodes x join named n on n.conv_id = x.conv_id and n.d <= x.depth),
parents as (select conv_id, depth, top as parent_conv_id from above where top_depth = depth - 1),
kids as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n_children from parents group by all),
inside as (select top as conv_id, top_depth as depth, count(*) as size, count(*) filter (k.n_children is null) as n_leaves, sum(w) as saved_tokens
    from above a join nodes n on a.conv_id = n.conv_id and a.depth = n.depth left join kids k on k.conv_id = a.conv_id and k.depth = a.depth group by all),
steps as (select p.conv_id, p.depth, p.parent_conv_id, 1 + 2 * (sum(i.size) over (partition by p.parent_conv_id, p.depth order by p.conv_id) - i.size) as step from parents p join inside i on i.conv_id = p.conv_id and i.depth = p.depth),
enters as (select a.conv_id, a.depth, coalesce(sum(s.step), 0) as enter_at from above a left join steps s on s.conv_id = a.top and s.depth = a.top_depth group by all)
select n.conv_id, n.depth, p.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, i.n_leaves, cast(i.saved_tokens as bigint) as saved_tokens,
    sha256(coalesce(m.ids, '')) as ends_sha256, cast(e.enter_at as bigint) as enter_at, cast(e.enter_at + 2 * i.size - 1 as bigint) as exit_at
from nodes n join inside i on i.conv_id = n.conv_id and i.depth = n.depth join enters e on e.conv_id = n.conv_id and e.depth = n.depth
left join parents p on p.conv_id = n.conv_id and p.depth = n.depth left join kids k on k.conv_id = n.conv_id and k.depth = n.depth
left join members m on m.conv_id = n.conv_id and m.depth = n.depth
"""
