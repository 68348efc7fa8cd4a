"""Secret scan and decontamination on odd rows and against plain Python."""

import hashlib
import random
import re
from itertools import combinations

from ledgerlake.llm import decontamination, secret_scan
from ledgerlake.llm.common import table


def base_spans(text):
    out = []
    for k, (pattern, least) in enumerate([(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None), (r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)]):
        for m in re.finditer(pattern, text or "", re.I | re.A if k == 0 else re.A):
            if len(m[2]) >= 8 if k == 0 else len(m[0]) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check(rows, got):
    kinds = ("assign", "access", "hex")
    want = sorted((str(d), *(sum(s[1] == k for s in base_spans(t)) for k in range(3)), hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base_spans(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want


def test_base_spans(spark):
    texts = ["token: api_key = \"abcdefghijk\"", "😀 password='abcdefgh' PASSWORD = short", "AKIAABCDEFGHIJKL AKIASHORT xAKIA123456789012345", "0123456789abcdef0123456789abcdef0", "a" * 31 + " " + "f" * 70, "token=" * 3000 + "x" * 50, None, "", "secret" + " " * 5000 + ":abcdefghi", "tOkEn=\"" + "9f" * 20 + "\"\n" * 3]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[1])]
    df = spark.createDataFrame([(d, t, "s", 1) for d, t in rows], "doc_id long, text string, source string, base int")
    got = secret_scan.secrets(df).collect()
    check(rows, got)
    assert secret_scan.secrets(df.limit(0)).count() == 0
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], secret_scan.secrets(docs).collect())


def test_ownership(spark):
    copied, own, added = "password=Hunter2Hunter2xyz", "token=q8Zr5TbN0wLk", "Zk3Jq9Xw7Lp2Vb8Nm4Rt6"
    rows = [(i, copied, f"s{i % 5}") for i in range(20)] + [(20, f"{own} {added}", "s1"), (21, own, "s1"), (22, "token=exampletoken", "s2")] + [(30 + i, "Copied3Copied9Token5Value7", f"s{i}") for i in range(4)]
    got = {r.doc_id: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all((got[i].n_live, got[i].n_example) == (0, 1) for i in range(20))
    assert (got[20].n_live, got[20].n_example, got[20].spans) == (2, 0, "assign:0:18,opaque:19:40")
    assert (got[21].n_live, got[22].n_live) == (1, 0) and got[30].spans == "" and got[30].n_example == 0


def test_leaks(spark):
    passage = [f"w{i}" for i in range(30)]
    swapped = [w if i % 6 else f"other{i}" for i, w in enumerate(passage)]
    half = passage[:8] + [f"z{i}" for i in range(20)]
    short = "five words in an item"
    rows = [(1, "x y " + " ".join(passage) + " z"), (2, "intro, " + "; ".join(swapped).upper()), (3, " ".join(half)), (4, short + " here"), (5, "five words in an object"), (6, None), (7, ""), (None, " ".join(passage)), (1, "x y " + " ".join(passage) + " z"), (8, "common " * 30000 + " ".join(passage))]
    items = [(10, " ".join(passage)), (11, short), (12, None), (13, "two words"), (14, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, shift int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.aligned, r.doc_start) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 10): (30, 30, 2), (2, 10): (25, 30, 1), (4, 11): (5, 5, 0), (None, 10): (30, 30, 0), (8, 10): (30, 30, 30000)}
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [3, 5, 6, 7]
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_clean_rows_beside_leaking_ones(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(None, passage), (None, "clean without an id"), (None, None), (1, passage), (1, "clean with the same id"), (2, passage + " end"), (2, passage + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(10, passage)], "item_id long, text string")
    kept = decontamination.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[2], rows[4]], key=repr)


def test_short_and_cut_passages(spark):
    def changed(words, places):
        return " ".join(f"z{i}" if i in places else w for i, w in enumerate(words))

    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (6, 7, 8, 9, 10, 14, 30)}
    rows, want = [], set()

    def add(text, item):
        if item:
            want.add((len(rows), item))
        rows.append((len(rows), text))

    for n, differ in ((6, 1), (7, 1), (8, 1), (9, 1), (10, 2), (14, 2)):
        for places in combinations(range(n), differ):
            add("before " + changed(items[n], places) + " after", n)
        add("before " + changed(items[n], range(differ + 1)) + " after", None)
    long = items[30]
    add(" ".join(long[-13:]) + " and more words", 30)
    add("some words " + " ".join(long[:13]), 30)
    add(" ".join(long[-12:]) + " and more words", None)
    add("some words " + " ".join(long[:12]), None)
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往"
    add("前言" + han[:5] + "某" + han[6:] + "后记", 99)
    add("前言" + han[:10] + "某某某某某某某某某某", None)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*((n, " ".join(w)) for n, w in items.items()), (99, han)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, bench).collect()} == want


def test_masks_miss_no_leak():
    """Of every length, whatever words differ or are cut off at an end of the document, a mask looks at none of them."""
    for n in range(decontamination.LEAST_WORDS, 20):
        window = min(n, decontamination.WINDOW)
        masks = decontamination.masks_of(n) if n <= decontamination.SHORT else decontamination.MASKS
        seen = [{i + o for o in m} for m in masks for i in range(n - m[-1])]
        for at in range(n - window + 1):
            for places in combinations(range(at, at + window), window - decontamination.required(window)):
                outside = (set(range(at)) | set(range(at + window, n))) if n > window else set()
                assert any(not p & (set(places) | outside) for p in seen), (n, places)


def test_leaks_against_all_alignments(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    items = [(100 + i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 4, 5, 6, 9, 12, 15, 16, 17, 40])))) for i in range(40)]
    rows = []
    for d in range(150):
        text = [rnd.choice(words) for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            w = [x if rnd.random() > 0.15 else "other" for x in rnd.choice(items)[1].split()]
            at = rnd.randrange(len(text) + 1)
            text[at:at] = w[rnd.randrange(3) :]
        rows.append((d, " ".join(text)))
    want = set()
    for d, text in rows:
        x = text.split()
        for item, t in items:
            w = t.split()
            if len(w) < decontamination.LEAST_WORDS:
                continue
            best = None
            for shift in range(-len(w) + 1, len(x)):
                first, last = max(0, -shift), min(len(w), len(x) - shift)
                same = [w[i] == x[i + shift] for i in range(first, last)]
                win = min(decontamination.WINDOW, len(w))
                score = max(sum(same[i : i + win]) for i in range(len(same) - win + 1)) if len(same) >= win else sum(same)
                if score >= decontamination.required(win):
                    best = max(best or (0,), (sum(same), -(first + shift), len(same)))
            if best:
                want.add((d, item, best[0], best[2], -best[1]))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontamination.leaks(docs, bench).select("doc_id", "item_id", "matched", "aligned", "doc_start").collect()}
    assert got == want and len(want) > 50
    assert {r.item_id for r in decontamination.unusable_items(bench).collect()} == {i for i, t in items if len(t.split()) < 5}


def test_many_matches_in_a_text(spark):
    rnd = random.Random(2)
    text = " ".join(f"{rnd.getrandbits(128):032x}" + ("" if i % 50 else " Zk3Jq9Xw7Lp2Vb8Nm4Rt6") for i in range(20_000))
    rows = [(1, text), (2, " ".join(["password=Hunter2Hunter2xyz"] * 700))]
    got = secret_scan.secrets(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")).collect()
    check(rows, got)
    assert {r.doc_id: r.spans.count("opaque") for r in got} == {1: 400, 2: 0}


def test_shared_by_one_owner(spark, monkeypatch):
    rows = [(i, "password=Hunter2Hunter2xyz", "s1") for i in range(12)] + [(20, "token=q8Zr5TbN0wLk", "s1"), (21, "token=q8Zr5TbN0wLk", "s2"), (22, "token=q8Zr5TbN0wLk Zk3Jq9Xw7Lp2Vb8Nm4Rt6", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for hot in (secret_scan.HOT_SPANS, 3):
        monkeypatch.setattr(secret_scan, "HOT_SPANS", hot)
        seen.append(sorted(tuple(r) for r in secret_scan.secrets(docs).collect()))
    got = {r[0]: r[6:] for r in seen[0]}
    assert all(got[i] == (0, 1, 0, 12) for i in range(12)) and got[20] == (0, 0, 1, 3) and got[22] == (1, 0, 1, 3) and seen[0] == seen[1]
