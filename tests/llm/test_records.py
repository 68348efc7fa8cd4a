import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from ledgerlake.llm import queries, records
from ledgerlake.llm.common import new_folder, table
from tokenizers import Tokenizer


def expected(rows):
    """start, n_tokens and crc of each text, encoded whole."""
    t = Tokenizer.from_file(queries.tokenizer_path())
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df, folder=None):
    out = records.digest(df, queries.tokenizer_path(), folder)
    return sorted((tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_round_trip_of_documents(spark, sf):
    docs = table(spark, sf, "documents").repartition(5)
    assert got(docs) == expected(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))


def test_odd_texts(spark):
    texts = [None, "", "a\x01b c", "İstanbul ΣΑΣ é É é", "<|endoftext|> x <|ENDOFTEXT|>", "it's I'LL 12 ..., y z", "w " * 60000, "x" * 100000, "same", "same", "\x1c\x85 q"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(4, "<|endoftext|> x <|ENDOFTEXT|>", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    assert got(df) == expected(sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]))
    with_null = spark.createDataFrame([(None, "n"), (1, "m")], "doc_id long, text string")
    assert got(with_null) == expected([(None, "n"), (1, "m")])
    assert got(df.limit(0)) == []


def test_index_and_damage(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").filter("doc_id < 40")
    folder = new_folder(spark, "records")
    index = records.write_records(docs, folder, queries.tokenizer_path()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {e[0]: e for e in expected(sorted(texts.items()))}
    for r in index[::7]:
        doc_id, ids = records.read_at(r.file, r.offset)
        assert doc_id == r.doc_id and (len(ids), zlib.crc32(ids.tobytes())) == whole[doc_id][2:]
    data = bytearray(records.frame(b"payload"))
    data[14] ^= 1
    path = tmp_path / "bad.rec"
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(ValueError):
        list(records.read_frames(f))


def test_pieces_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(records, "CACHED_PIECES", 8)
    t, e = Tokenizer.from_file(queries.tokenizer_path()), records.Encoder(queries.tokenizer_path())
    assert e.by_piece
    for text in ("a b c d", "c d e f", "g h", "a b c d e f g h i j", "a z"):
        ids, at = e.batch(pa.array([text, None, text]))
        one = t.encode(text, add_special_tokens=False).ids
        assert list(ids) == one * 2 and list(at) == [0, len(one), len(one), 2 * len(one)]
        assert len(e.known) <= 60 and len(e.known) == len(e.starts) == len(e.sizes)


def test_pieces_of_texts():
    t, e = Tokenizer.from_file(queries.tokenizer_path()), records.Encoder(queries.tokenizer_path())
    rnd = random.Random(6)
    signs = ["'", '"', "s", "T", "ll", "é", "İ", "ß", "漢", "\u0301", "\u0338", "<", "=", "|", ">", "-", "_", "0", "9", " ", "\n", "\x0b", "\x85", "\xa0", "😀", "a", "b", ".", ",", "ﬁ", "½"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    ids, at = e.batch(pa.array(texts))
    for i, text in enumerate(texts):
        assert list(ids[at[i] : at[i + 1]]) == t.encode(text, add_special_tokens=False).ids, text


def test_a_tokenizer_that_does_not_work_by_pieces(tmp_path):
    """One that knows case gets whole texts."""
    from tokenizers import models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"A": 0, "a": 1, "[UNK]": 2, records.MARK: 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.save(str(tmp_path / "t.json"))
    e = records.Encoder(str(tmp_path / "t.json"))
    assert not e.by_piece and list(e.batch(pa.array(["A a", "", "a b"]))[0]) == [0, 1, 1, 2]


def test_rows_of_one_id_in_several_files(spark):
    rows = [(None if i % 3 else 7, f"text {i * 7919 % 1000:04d} " + "and more " * (i % 40)) for i in range(300)]
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = records.digest(df, queries.tokenizer_path()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out), key=lambda r: r[1]) == expected(ordered)
    assert len({r.shard for r in out if r.doc_id is None}) > 1
