import zlib
from collections import Counter

import numpy as np
from ledgerlake.llm import mixing, sharding
from ledgerlake.llm.common import table


def test_permutation():
    for n in (1, 2, 3, 16, 17, 1000, 4097):
        places = sharding.permute(np.arange(n), n, seed=3)
        assert sorted(places) == list(range(n)) and list(sharding.permute(places, n, 3, back=True)) == list(range(n))
    assert list(sharding.permute(np.arange(1000), 1000, 1)) != list(sharding.permute(np.arange(1000), 1000, 2))
    shard, slot = sharding.shard_of(123, 1000, 16)
    assert sharding.row_of(shard, slot, 1000, 16) == 123


def plain_place(row, n, seed=0):
    """Six rounds of a Feistel network on the smallest even number of bits, in plain integers, walked until the place is below n."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m64
        return x ^ x >> 31

    bits = 2
    while 1 << bits < n:
        bits += 2
    half = bits // 2
    while True:
        left, right = row >> half, row & (1 << half) - 1
        for r in range(6):
            key = mix((seed * 6 + r + 1) * 0x9E3779B97F4A7C15 & m64)
            left, right = right, left ^ mix(right + key & m64) & (1 << half) - 1
        row = left << half | right
        if row < n:
            return row


def test_places_in_plain_integers():
    for n in (1, 2, 5, 16, 17, 1000, 4096, 4097):
        for seed in (0, 3):
            assert [plain_place(g, n, seed) for g in range(n)] == sharding.permute(np.arange(n), n, seed).tolist()


def test_shards_of_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.digest(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" for r in rows)
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sorted((r.row, r.doc_id) for r in rows) == list(enumerate(sorted(texts)))
    assert all((r.slot * 16 + r.shard) == plain_place(r.row, len(rows)) for r in rows)
    again = sharding.digest(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_odd_rows(spark):
    rows = [(1, None, 9), (1, None, 9), (None, "é", 9), (2, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    got = sharding.digest(df).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == {(1, 1, 0): 2, (None, 3, zlib.crc32("é".encode())): 1, (2, 1, 0): 1}
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert sharding.digest(df.limit(0)).count() == 0


def levels(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and left * weight[s] / w >= 3 * sizes[s]]
        if not over:
            return {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        capped |= set(over)
        if len(capped) == len(names):
            return {s: 3.0 * sizes[s] for s in names}


def test_targets_and_copies(spark):
    rows = [(i, "w " * (i % 37), f"s{(i * i) % 23}") for i in range(2000)] + [(9000 + i, "big " * 50, "s0") for i in range(900)] + [(50007, None, None), (50007, None, None), (50008, "a\x0bb", None), (None, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.digest(df).join(df.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes["0" + s if s is not None else "1"] += len((t or "").split())
    want = levels(sizes)
    joined = {("0" + r.source if r.source else "1" if r.doc_id else "0tiny"): r for r in got}
    assert all(abs(joined[s].target - t) < 1e-6 * max(1, t) and joined[s].source_size == sizes[s] for s, t in want.items())
    taken = Counter()
    for r in got:
        taken["0" + r.source if r.source else "1" if r.doc_id else "0tiny"] += r.taken
        assert r.taken in range(0, 3 * r.size + 1, max(1, r.size))
    assert all(abs(taken[s] - want[s]) <= 51 for s in want), (taken, want)
    again = mixing.digest(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert mixing.digest(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    names = ["copies", "row", "h", "size", "key", "n", "id", "hash", "copy", "offset", "rate", "docs", "weight", "_h", "_copy", "target", "source_size", "first_row"]
    rows = [(i, f"{'w ' * (i % 9)}{i}", f"s{i % 3}", *range(len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    out = mixing.mix(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows)
    copies = {r.doc_id: r.copies for r in mixing.digest(docs).collect()}
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in copies.items() if c})
