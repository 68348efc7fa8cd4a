"""The trie of prefixes against plain Python, and list ranking in orders that suit it and that don't."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from ledgerlake.llm import prefix_trie
from pyspark.sql import functions as F


def plain(rows):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    out, clock = {}, 0

    def weight(k):
        return (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0

    done = {}
    stack = [((), False)] if members else []
    enter = {}
    while stack:
        k, back = stack.pop()
        if not back:
            enter[k] = clock
            clock += 1
            stack.append((k, True))
            stack += [(x, False) for x in sorted(children[k], key=lambda x: -members[x][0])]
            continue
        done[k] = (sum(done[x][0] for x in children[k]) or 1, weight(k) + sum(done[x][1] for x in children[k]))
        ends = ",".join(str(c) for c in members[k] if len(rebuilt[c]) == len(k))
        out[members[k][0], len(k)] = (members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), *done[k], hashlib.sha256(ends.encode()).hexdigest(), enter[k], clock)
        clock += 1
    return out


def check(rows, df, **more):
    got = {(r.conv_id, r.depth): tuple(r)[2:] for r in prefix_trie.trie(df, **more).collect()}
    want = plain(rows)
    assert got == want
    return got


COLUMNS = "conv_id long, turn long, role string, text string, row int, depth int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS).repartition(3)


def test_conversations(spark):
    draw = random.Random(3)
    rows = []
    for c in range(120):
        rows += [(c if c % 11 else 7 * c + 1, None if t == 0 else t, draw.choice(["user", None, "ü"]), draw.choice(["a", "bé", None, "c" * 30]) if t > 1 else "hello") for t in range(draw.randrange(1, 14))]
    rows += [(None, 1, "user", "x"), (5001, 0, "user", "alone"), (5003, 2, None, None), (9_000_000_000_005, 0, "user", "hello")]
    seen, once = set(), []
    for r in rows:  # rows that tie in turn have an order of their own, tested below
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            once.append(r)
    got = check(once, frame(spark, once))
    assert got == check(once, frame(spark, once), block=8) and max(d for _, d in got) > 8
    assert prefix_trie.trie(frame(spark, once).limit(0)).count() == 0


def test_ties_and_repeated_rows(spark):
    rows = [(0, 1, "user", "a"), (0, 1, "user", "b"), (0, 1, "user", "b"), (10, 1, "user", "b"), (10, 1, "user", "a"), (10, 1, "user", "b")]
    got = prefix_trie.trie(frame(spark, rows)).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs) for r in got) == [(0, d, 2) for d in range(4)]
    assert {r.ends_sha256 for r in got if r.depth == 3} == {hashlib.sha256(b"0,10").hexdigest()}


def test_long_and_common(spark, monkeypatch):
    """A conversation of many turns (in runs), thousands of the same (in pieces), and a node with many children (broadcast)."""
    monkeypatch.setattr(prefix_trie, "RUN", 64)
    monkeypatch.setattr(prefix_trie, "PIECE", 500)
    monkeypatch.setattr(prefix_trie, "HOT", 200)
    rows = [(1000 * 5, t, "user", str(t % 7)) for t in range(700)] + [(1000 * 5 + 1, t, "user", str(t % 7)) for t in range(650)]
    rows += [(5 * c, 0, "user", "hi") for c in range(1, 900)] + [(5 * c, 1, "bot", f"answer {c % 450}") for c in range(1, 900) if c % 3]
    check(rows, frame(spark, rows), block=256)


def test_ranks_in_any_order(spark):
    draw = np.random.default_rng(5)
    for order in (np.arange(600), draw.permutation(600), np.arange(600).reshape(2, 300).T.ravel()):
        weights = draw.integers(0, 9, 600)
        rows = [(int(i), int(order[k + 1]) if k < 599 else -1, 1, int(weights[k]), 2 * k) for k, i in enumerate(order)]
        draw.shuffle(rows)
        items = spark.createDataFrame([tuple(map(int, r)) for r in rows], "id long, next long, n long, leaves long, saved long")
        got = {r.id: (r.at, r.leaves, r.saved) for r in prefix_trie.ranked(items, block=64).collect()}
        before = np.concatenate([[0], np.cumsum(weights)])
        assert got == {int(i): (k, int(before[k]), k * (k - 1)) for k, i in enumerate(order)}


def test_given_conversations(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    check([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], df)
    assert df.filter(F.col("conv_id").isNull()).count() == 0
