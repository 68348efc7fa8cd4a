"""The acceptance scan against a plain loop."""

import random
import zlib

from ledgerlake.functions import rules
from ledgerlake.operators import filings
from pyspark.sql import functions as F


def loop(rows, held, targets, refresh, failing=()):
    """Newest day first, list order within a day: one acceptance after another."""
    held, targets, out = dict(held), set(targets), []
    for code, off, seq, doc, ts, date in sorted(rows, key=lambda r: (r[1], r[2])):
        submit = ts or date or ""
        if code in targets:
            policy = rules.ADDED_POLICY
        elif off < refresh and (code not in held or (doc != held[code][0] and (not held[code][1] or submit > held[code][1]))):
            policy = rules.REFRESHED_POLICY
        else:
            continue
        if doc in failing:
            out.append((code, doc, rules.FAILED))
            continue
        targets.discard(code)
        held[code] = (doc, ts or "")
        out.append((code, doc, policy))
    return sorted(out)


def test_scan_is_the_loop(spark):
    rnd = random.Random(11)
    rows, held, targets = [], {}, set()
    for c in range(400):
        code = f"{c:04d}"
        docs = [f"D{c}-{i}" for i in range(rnd.randrange(1, 7))]
        for i, d in enumerate(docs):
            ts = f"2024-01-{rnd.randrange(1, 6):02d} 10:00" if rnd.random() > 0.2 else None
            rows.append((code, rnd.randrange(0, 160), c * 10 + i, rnd.choice(docs) if rnd.random() < 0.2 else d, ts, "2024-01-03" if rnd.random() < 0.5 else None))
        kind = rnd.randrange(3)
        if kind == 0:
            targets.add(code)
        elif kind == 1:
            held[code] = (rnd.choice([*docs, None]), rnd.choice(["", "2024-01-02 10:00", "2024-01-04 10:00"]))
    df = spark.createDataFrame(rows, "code string, day_offset int, day_seq int, doc_id string, submit_ts string, submit_date string")
    records = spark.createDataFrame([(c, d, f) for c, (d, f) in held.items()], "code string, document_id string, filed_at string")
    wanted = spark.createDataFrame([(c,) for c in targets], "code string")
    joined = df.withColumn("submit", filings.submitted()).join(records.withColumn("has_record", F.lit(True)), "code", "left").withColumn("has_record", F.coalesce("has_record", F.lit(False)))
    all_rows = joined.join(wanted.withColumn("is_target", F.lit(True)), "code", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    got = filings.accepted_filings(all_rows, 90).select("code", "doc_id", "policy").collect()
    assert sorted(map(tuple, got)) == loop(rows, held, targets, 90)
    # pruning before archives are read never drops what would be accepted
    pruned = filings.accepted_filings(filings.candidates(df, records, wanted, 90), 90).select("code", "doc_id", "policy").collect()
    assert sorted(map(tuple, pruned)) == loop(rows, held, targets, 90)
    # archives that fail change nothing, and count where they would have been taken
    bad = {r[3] for r in rows if zlib.crc32(r[3].encode()) % 5 == 0}
    tried = filings.candidates(df, records, wanted, 90).withColumn("failed", F.col("doc_id").isin(*bad))
    got = filings.scanned_filings(tried, 90).select("code", "doc_id", "policy").collect()
    assert sorted(map(tuple, got)) == loop(rows, held, targets, 90, bad) and any(r.policy == rules.FAILED for r in got)


def test_upsert_and_totals(spark):
    records = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "code string, document_id string, filed_at string")
    new = spark.createDataFrame([("2", "c", "z", "p"), ("3", "d", "w", "p")], "code string, document_id string, filed_at string, policy string")
    assert sorted(map(tuple, filings.upserted(records, new).collect())) == [("1", "a", "x", None), ("2", "c", "z", "p"), ("3", "d", "w", "p")]
    accepted = spark.createDataFrame([("1", rules.ADDED_POLICY), ("2", rules.REFRESHED_POLICY), ("2", rules.FAILED), ("2", rules.REFRESHED_POLICY)], "code string, policy string")
    got = filings.run_totals(accepted, records, spark.sql("select 10L added, 20L refreshed, 3 failures")).first()
    assert tuple(got) == (11, 22, 4, 2)
