import random
import re
from collections import defaultdict

import pytest
from ledgerlake.llm import near_dedup
from ledgerlake.llm.common import table


def brute(rows):
    """The contract on plain Python sets, all pairs that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where, common = defaultdict(list), defaultdict(int)
    for d in sorted(sets):
        for s in sets[d]:
            for o in where[s]:
                common[o, d] += 1
            where[s].append(d)
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c) and root(a) != root(b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {(d, len(s), root(d), root(d) == d) for d, s in sets.items()}


def result(df):
    return {tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_matches_brute_force_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block", [3, near_dedup.BLOCK])
def test_groups_around_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(20)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([3, 6, 12, 40, 200]))]
        for _ in range(15):
            w = base[:] if rnd.random() < 0.2 else [x if rnd.random() > 0.02 else word() for x in base]
            rows.append((len(rows), " ".join(w).upper()))
    for _ in range(60):  # documents that share a passage, and little else
        rows.append((len(rows), " ".join(passage + [word() for _ in range(rnd.choice([3, 8, 30]))])))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \t", 7), (4, "one two", 7), (5, "One\x0bTWO", 7), (6, "one two three", 7), (None, "one two", 7), (9, "a b c d e f", 7), (9, "a b c d e f", 7), (8, "x " * 40000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = sorted(near_dedup.near_duplicates(df).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r) for r in out] == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (8, 1, 8, True), (9, 2, 9, True), (9, 2, 9, True), (None, 1, None, True)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_estimate_follows_jaccard():
    import numpy as np

    rnd = np.random.default_rng(1)
    errors = []
    with np.errstate(over="ignore"):
        for n in (4, 20, 100, 1000):
            for _ in range(20):
                pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
                a, b = pool[: n + n // 2], pool[n // 2 :]
                r = near_dedup.registers([a, b])
                errors.append((r[0] == r[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.03


def test_ids_that_texts_share(spark):
    rnd = random.Random(8)
    a, b, c = ([f"{x}{rnd.randrange(10**6)}" for _ in range(80)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    a, a2, b, b2, c, c2 = " ".join(a), near(a), " ".join(b), near(b), " ".join(c), near(c)
    rows = [(1, a), (2, a2), (2, b), (3, b2), (4, c), (4, c2), (4, c), (5, c.upper()), (None, a), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), *[(4, 4, True)] * 3, (5, 4, False), (None, None, True), (6, 6, True)], key=repr)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    left = sorted((tuple(r) for r in kept.collect()), key=repr)
    assert left in [sorted([(1, a), (2, b), (4, x), (None, a), (6, "")], key=repr) for x in (c, c2)]


@pytest.mark.parametrize("block", [3, near_dedup.BLOCK])
def test_hubs_are_dealt(spark, monkeypatch, block):
    """Many documents share a passage with the smallest of their bucket, and some are linked with it: its pairs go to several tasks."""
    monkeypatch.setattr(near_dedup, "HUB", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    rows = []
    for i in range(90):
        w = base[:]
        for p in rnd.sample(range(60), rnd.choice([0, 1, 1, 2, 3, 9])):
            w[p] = word()
        rows.append((i, " ".join(w + [word() for _ in range(rnd.choice([0, 4, 20]))])))
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)
