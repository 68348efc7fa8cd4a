"""A JSON object that is read in ranges of bytes, wherever those begin, against the json module and the reader of one value."""

import io
import json
import random

import pytest
from ledgerlake.sources import ranges, snapshots

NASTY = ["plain", 'quote " and \\ back', "\\\\\\", '{"a": [1, 2}', "comma, colon: brace {", "日本語 é  ", "", '\\"', "x" * 50]


def made(n, seed=0):
    draw = random.Random(seed)

    def value(depth):
        kind = draw.randrange(6 if depth else 4)
        if kind == 5:
            return {draw.choice(NASTY) + str(i): value(depth - 1) for i in range(draw.randrange(4))}
        return [value(depth - 1) for _ in range(draw.randrange(3))] if kind == 4 else draw.choice([draw.choice(NASTY), 1.5, None, True, -3])

    return {"generatedAt": draw.choice(NASTY), "stats": {k + "s": draw.random() for k in NASTY}, "list": [1, {"records": 2}], "records": {f"{draw.choice(NASTY)}{i}": value(3) for i in range(n)}, "more": {}, "last": {"z": "}"}}


@pytest.mark.parametrize("form", [{}, {"indent": 1}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_entries_of_ranges(form):
    for seed in range(6):
        whole = made(12, seed)
        text = json.dumps(whole, **form).encode()
        want = [(top, k, v) for top, o in whole.items() if isinstance(o, dict) for k, v in o.items()]
        for step in (1, 2, 3, 7, 64, 1000, len(text)):
            f, open_, in_string, depth, got = io.BytesIO(text), None, False, 0, []
            for start in range(0, len(text), step):
                end = min(len(text), start + step)
                for top, key, value in ranges.entries_in(f, start, end, len(text), in_string, depth, ahead=5):
                    open_ = open_ if top is None else top
                    if key is not None:
                        got.append((open_, key, json.loads(value)))
                quotes, outside, inside = ranges.state_change(ranges._bytes(f, start, end), ranges._backslashes(f, start))
                depth += inside if in_string else outside
                in_string ^= quotes % 2 == 1
            assert got == want and not in_string and depth == 0, (seed, step)


def test_snapshot_of_ranges(spark, tmp_path):
    draw = random.Random(1)
    records = {f"{i:04d}": {"code": f"{i:04d}" if i % 9 else "other", "companyName": draw.choice(NASTY), "metrics": {"roe": {"value": draw.random(), "trend": [1.0, 2.0]}, "per": {"value": "@"}}, "history": [{"year": "2023", "roe": i}]} for i in range(400)}
    text = "﻿" + json.dumps({"generatedAt": 'a"b', "stats": {"a": 1.5, "b": 2}, "records": records, "quotes": {"1": {"close": 10.0}}, "fundamentals": {"1": {"eps": 2.0}}}, ensure_ascii=False, indent=1).replace('"@"', "NaN")
    path, broken, small = (str(tmp_path / n) for n in ("big.json", "broken.json", "small.json"))
    (tmp_path / "big.json").write_text(text, encoding="utf-8")
    (tmp_path / "broken.json").write_text(text[:-30], encoding="utf-8")
    (tmp_path / "small.json").write_text("{oops")
    key = lambda df: sorted(map(str, df.collect()))
    one = key(snapshots.read_records(spark, path, step=1 << 30))
    assert len(one) == 400 - 45
    for step in (1000, 4001):
        assert key(snapshots.read_records(spark, path, step=step)) == one
    assert key(snapshots.read_records(spark, broken, path, step=5000)) == one == key(snapshots.read_records(spark, small, path, step=5000))
    assert snapshots.read_records(spark, broken, step=5000).count() == 0
    quotes, fundamentals = snapshots.read_market(spark, path, step=5000)
    assert quotes.first().close == 10.0 and fundamentals.first().eps == 2.0
    assert ranges.read_entries(spark, path, 3000).filter("top = 'records'").rdd.getNumPartitions() > 1
