import math
import random
from collections import Counter

from ledgerlake.llm import langid
from ledgerlake.llm.common import table


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) <= 2


def test_odd_rows(spark):
    rows = [(i, f"der die und das {i} wort haus" if i % 2 else f"the and that {i} word house", "de" if i % 2 else "en", 1.0) for i in range(40)]
    rows += [(40, None, "de", 1.0), (41, "", "en", 1.0), (42, "12 345 !?", None, 1.0), (None, "und der", None, 1.0), (43, "ψ щ ж", None, 1.0), (44, "the " * 50000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.digest(df).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[42].rejected and got[42].score == 0
    assert got[None].lang_pred == "de" and got[44].lang_pred == "en" and got[43].lang_pred != "und" and got[43].rejected
    assert langid.digest(df.limit(0)).count() == 0
    unlabelled = langid.digest(df.withColumn("lang", df.lang.substr(9, 1)).filter("lang is null")).collect()
    assert all(r.lang_pred == "und" for r in unlabelled)


def plain_prediction(model, text):
    """Language, cosine and rejection of a text from plain dicts."""
    symbols = [32 if c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in (" " + text.lower() + " ").encode()]
    counts = Counter()
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        if (b, c) != (32, 32):
            counts[((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 19] += 1
    x = {i: math.log1p(n) * float(model.idf[i]) for i, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    cos = [sum(v * float(c[i]) for i, v in x.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=cos.__getitem__)
    return model.languages[best], cos[best], cos[best] < model.least[best]


def test_predictions_against_plain_dicts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.learn(docs)
    assert len(set(model.languages)) == 4 and len(model.languages) > 4
    texts = {r.doc_id: r.text for r in docs.filter("length(text) < 4000").limit(120).collect()}
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model, ["doc_id"]).collect()}
    for i, t in texts.items():
        lang, score, rejected = plain_prediction(model, t)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4 and got[i].rejected == rejected


def test_rejection(spark):
    """Texts of other languages, code and noise go; held-out documents stay."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = langid.learn(docs)
    rnd = random.Random(4)
    other = [
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 4, "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。" * 4,
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 4, "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. " * 4,
        "for (int i = 0; i < n; ++i) { x[i] = y[i] * z[i]; } if (!ok) return -1; " * 6, "كل الناس يولدون أحرارا متساوين في الكرامة والحقوق. " * 4,
        *("".join(rnd.choice("0123456789abcdef") for _ in range(400)) for _ in range(6)), *(" ".join("".join(rnd.choice("qxzjkvw") for _ in range(6)) for _ in range(60)) for _ in range(6)),
    ]
    assert all(model.predict(other)[2])
    held = langid.digest(docs).filter("held_out and lang_pred <> 'und'")
    assert held.filter("rejected").count() <= 0.005 * held.count()
