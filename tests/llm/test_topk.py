import numpy as np
from ledgerlake.llm import topk
from ledgerlake.llm.common import table


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            found = sorted((-int(a @ b), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in topk.top_k(df).collect())


def test_embeddings(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    assert result(df) == brute([(r.vec_id, r.embedding) for r in df.collect()])


def test_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.standard_normal(4)]) for i in range(300)] + [(1000 + i, [0.5, 0.25, 0.0, -1.0]) for i in range(2000)]
    rows += [(5000, None), (5020, [1.0, None, 0.0, 0.0]), (5040, [1.0, float("nan"), 0.0, 0.0]), (5060, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (5080, [0.0] * 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v int")
    assert result(df) == brute(rows)
    few = rows[:7]
    assert result(spark.createDataFrame(few, "vec_id long, embedding array<double>")) == brute(few)
    assert topk.top_k(df.limit(0)).count() == 0


def test_pages_are_left_out():
    """Of well separated clusters a search visits its own."""
    rnd = np.random.default_rng(3)
    v = np.concatenate([rnd.integers(-3, 4, (100, 8)) + c for c in (np.eye(8, dtype=int) * 500)]).astype(np.int64)
    m2 = int(topk.lengths(v).max())
    node = topk.build_node(np.arange(len(v)), v, m2)
    seen, real = [], topk.products
    topk.products = lambda a, b: (seen.append(a.shape[0] * b.shape[0]), real(a, b))[1]
    try:
        topk.search_node(node, np.array([0]), v[:1], np.array([topk.LOWEST]), 5, m2)
    finally:
        topk.products = real
    assert sum(seen[1:]) < len(v) / 2


def test_deep_trees(spark, monkeypatch):
    """Several levels, rows that repeat, and a vector that a third of all rows have; the result doesn't change."""
    for name, value in (("NODE", 24), ("PAGE", 6), ("FAN", 4), ("BLOCK", 8), ("CHUNK", 2), ("WAVE", 2), ("LEVELS", 12)):
        monkeypatch.setattr(topk, name, value)
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.standard_normal(3)]) for i in range(500)] + [(1000 + i, [0.5, 0.25, -1.0]) for i in range(300)]
    rows += [(3001, [1.0, 2.0, 0.5])] * 120
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    v = topk.written(topk.integers(df), "v")
    leaves, inner, levels = topk.grow(v, len(rows), 3, max(sum(int(x) ** 2 for x in r.v) for r in v.collect()))
    sizes = [r["count"] for r in leaves.groupBy("node").count().collect()]
    assert levels > 2 and sum(sizes) == len(rows) and max(sizes) <= 48 and inner.count() > 4
    assert result(df) == brute(rows)
