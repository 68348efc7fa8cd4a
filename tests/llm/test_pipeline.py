import zlib

import corpus_pipeline
import duckdb
import numpy as np
from ledgerlake.llm import decontamination, langid, mixing, queries
from ledgerlake.llm.common import table, written
from test_near_dedup import brute
from tokenizers import Tokenizer


def test_stages_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], sf)))
    rows = [[tuple(r) for r in s.select("doc_id", "text").collect()] for s in steps[:5]]
    assert all(s.columns == docs.columns for s in steps[:5])

    model = langid.learn(docs)
    rejected = model.predict([t for _, t in rows[0]])[2]
    assert sorted(rows[1]) == sorted(r for r, bad in zip(rows[0], rejected, strict=True) if not bad)
    assert all(any(c.isalpha() for c in t) for _, t in rows[1]) and len(rows[1]) > 0.97 * len(rows[0])

    kept = {d for d, _, _, k in brute(rows[1]) if k}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r[0] in kept)

    con = duckdb.connect()
    con.register("documents", steps[2].toPandas())
    con.execute(f"create view benchmark as select * from '{sf}/benchmark.parquet'")
    bad = {r[0] for r in con.execute(decontamination.ORACLE).fetchall()}
    assert bad and sorted(rows[3]) == sorted(r for r in rows[2] if r[0] not in bad)

    con = duckdb.connect()
    con.register("documents", steps[3].toPandas())
    found = con.execute(mixing.ORACLE)
    at = [c[0] for c in found.description].index("copies")
    copies = {r[0]: r[at] for r in found.fetchall()}
    assert sorted(rows[4]) == sorted(r for r in rows[3] for _ in range(copies[r[0]]))

    t, start, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for doc_id, text in sorted(rows[4]):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in steps[5].collect()) == sorted(expected)


def test_odd_rows(spark, tmp_path):
    text = "the cat and the dog went to the house of the man and sat on the mat"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", None, 1), (None, text + " again", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "12 !", None, "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    spark.createDataFrame([(1, "zebra " * 20), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, seen = docs, []
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, str(tmp_path)))
        seen.append(sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()))
    assert seen[0] == [(False, 1), (False, 1), (False, 2), (True, 0)] and seen[1] == seen[2] == [(False, 1), (True, 0)]
    out = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, out, str(tmp_path)))
    assert out.count() == 0


def test_mix_with_repeated_rows(spark):
    rows = [(i % 5, "word " * (i % 3 + 1), f"s{i % 4}") for i in range(40)] + [(1, "one row", "hot")] * 7 + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.digest(docs).agg({"copies": "sum"}).first()[0]
    assert mixing.mix(docs).count() == taken


def test_columns_of_any_name(spark, tmp_path):
    names = ["_h", "_bad", "_id", "h", "id", "row", "node", "kept", "k1", "k2", "component", "component_id", "seed", "at", "w", "bad_h", "copies", "n", "lang_pred", "score", "rejected", "shard", "start", "seq", "n_tokens"]
    text = [f"{x} the cat and the dog went to the house of the man and sat on the mat {x} {x}" for x in "one two three four five six".split()]
    rows = [(i, t, "en", "a", *range(len(names))) for i, t in enumerate(text)]
    passage = "benchmark passages hold many words that nobody would write in the same order by chance alone"
    rows += [(10, f"{text[0]} {passage}", "en", "a", *range(len(names))), (11, f"the man of the house, the dog and the cat {passage}", "en", "a", *range(len(names)))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, out, str(tmp_path)))
        assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows) and not out.isEmpty(), name
    assert {r.doc_id for r in out.collect()} <= set(range(6))
    assert corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).count() == out.count()
