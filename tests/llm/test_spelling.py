"""Spelling variants against all pairs of words, and the signatures against all pairs of vectors."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from ledgerlake.llm import spelling
from ledgerlake.llm.spelling import FEW, FIRST, SECOND, signatures


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    return any(b[:i] + b[i + 1 :] == (a if len(a) < len(b) else a[:i] + a[i + 1 :]) for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return out


def check(rows, df):
    got = [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    return {r[0]: r for r in got}


def test_variants(spark):
    draw = random.Random(1)
    rows = []
    for stem, most in (("analyse", 200), ("Façade", 150), ("wonderful", 130), ("aaaaaaaa", 60), ("øresund", 30)):
        for k in range(12):
            at = draw.randrange(len(stem))
            variant = stem if k == 0 else draw.choice([stem[:at] + stem[at + 1 :], stem[:at] + "z" + stem[at:], stem[:at] + "y" + stem[at + 1 :]])
            rows += [(draw.randrange(5000), f"{variant} {variant.upper()}, {variant}") for _ in range(most // (k * k * 3 + 1) + 1)]
    # a chain of forms, a tie, an anagram and a run that is long
    rows += [(i, t) for i, t in enumerate(["chains " * 1000, "chainsa " * 180, "chainsab " * 30, "chainsabc " * 5, "tiebox " * 50 + "tieboy " * 50 + "tieboz " * 6, "listen silent enlist " * 9])]
    rows += [(i, "q" * 30000 + "r w") for i in range(6)] + [(i, "q" * 30000 + " w") for i in range(30)]
    rows += [(None, "chains× ÷÷÷÷÷÷ ÀÀÀÀÀÀ àààààà ") for _ in range(6)] + [(7, None), (8, ""), (9, "short a b"), (9, "short a b")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, word int").repartition(3)
    got = check(rows, df)
    assert got["chainsabc"][5] == "chains" and got["tieboz"][3] == "tiebox" and got["q" * 30000 + "r"][3] == "q" * 30000
    assert got["listen"][2] == 0 and got["ÀÀÀÀÀÀ"][2] == 0
    assert spelling.variants(df.limit(0)).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], docs)


@pytest.mark.parametrize("first, second", [(FIRST, SECOND), (2, 4), (3, 2)])
def test_near_vectors_share_a_signature(first, second):
    few = -(-3 // first) - 1
    assert few == FEW or first > 1
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdé") for _ in range(draw.randrange(4, 9))) for _ in range(150)]
    keys = {w: set(signatures(w, few, first, second)[0]) for w in words}
    for a, b in itertools.combinations(set(words), 2):
        x, y = Counter(a), Counter(b)
        if sum(((x - y) + (y - x)).values()) <= 2:
            assert keys[a] & keys[b], (a, b)
