"""The keyed snapshot, and a whole run from listing to status."""

import json

import pytest
from ledgerlake.functions import rules
from ledgerlake.operators import filings as choose
from ledgerlake.operators import records
from ledgerlake.plans import refresh
from ledgerlake.sources import keyed
from pyspark.sql import functions as F
from test_sources import archive, whole, xbrl


def made(spark, codes, note):
    return spark.createDataFrame([(c,) for c in codes], "code string").select("code", F.struct("code", F.lit(note).alias("documentId")).alias("r")).select("code", F.from_json(F.to_json("r"), keyed.RECORD).alias("record"))


def content(spark, path, number=None):
    return {r.code: r.record.documentId for r in keyed.read(spark, path, number).collect()}


def test_keyed_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "records")
    assert keyed.read(spark, path).count() == 0 and keyed.manifest(spark, path) is None
    codes = [f"{i:04d}" for i in range(300)]
    first = keyed.create(made(spark, codes, "old"), path, 32, stats={"n": 1})
    assert first["number"] == 0 and len(first["folders"]) == 32 and content(spark, path) == dict.fromkeys(codes, "old")
    second = keyed.upsert(made(spark, ["0003", "0004", "new"], "now"), path)
    changed = [b for b in second["folders"] if second["folders"][b] != first["folders"][b]]
    assert 1 <= len(changed) <= 3 and second["stats"] == {"n": 1}
    want = dict.fromkeys(codes, "old") | {"0003": "now", "0004": "now", "new": "now"}
    assert content(spark, path) == want and content(spark, path, 0) == dict.fromkeys(codes, "old")
    # a run that fails before it commits leaves the state as it was, whatever it wrote
    with monkeypatch.context() as m:
        m.setattr(keyed, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            keyed.upsert(made(spark, ["0001"], "lost"), path)
    assert content(spark, path) == want
    with pytest.raises(RuntimeError, match="another writer"):
        keyed._commit(spark, path, second)
    assert keyed.upsert(made(spark, [], "none"), path)["folders"] == second["folders"]
    assert keyed.vacuum(spark, path) >= len(changed) and content(spark, path) == want and keyed._numbers(spark, path) == [2]
    assert keyed.upsert(made(spark, ["zzz"], "first"), str(tmp_path / "fresh"))["number"] == 0 and content(spark, str(tmp_path / "fresh")) == {"zzz": "first"}


def sheet(*values):
    names = (("NetSales", "Duration"), ("OperatingIncome", "Duration"), ("ProfitLoss", "Duration"), ("NetAssets", "Instant"), ("Assets", "Instant"))
    return archive({"PublicDoc/a.xbrl": xbrl(*((t, f"{y}{k}", str(v * f)) for y, f in (("CurrentYear", 1), ("PriorYear", 0.5)) for (t, k), v in zip(names, values, strict=True)))})


def test_run(spark, tmp_path):
    (tmp_path / "list.csv").write_text("コード,銘柄名,市場・商品区分,33業種コード\n1301,甲,プライム,50\n1302,乙,プライム,3200\n1303,丙,プライム,6100\n130A,丁,グロース,3250\n1305,銀,プライム,7050\n1306,投信,ETF・ETN,-\n1307,戊,プライム,50\n", encoding="utf-8")
    for folder in ("index", "archives"):
        (tmp_path / folder).mkdir()
    day = lambda *rows: json.dumps({"results": [dict(zip(("docID", "secCode", "docTypeCode", "submitDateTime", "periodEnd"), r, strict=True)) for r in rows]})
    (tmp_path / "index/2024-06-01.json").write_text(day(("N1", "13010", "120", "2024-06-01 09:00", "2024-03-31"), ("N2", "13020", "120", "2024-06-01 10:00", None), ("N3", "13030", "140", "2024-06-01 10:00", None)))
    (tmp_path / "index/2024-06-05.json").write_text(day(("N5", "13070", "120", "2024-06-05 10:00", "2024-04-30"), ("N6", "13050", "120", "2024-06-05 10:00", None)))
    (tmp_path / "index/2020-01-01.json").write_text(day(("OLD", "13030", "120", "2020-01-01 09:00", None)))
    (tmp_path / "archives/N1.zip").write_bytes(sheet(1000, 90, 60, 400, 1000))
    (tmp_path / "archives/N2.zip").write_bytes(b"broken")
    (tmp_path / "archives/N5.zip").write_bytes(sheet(500, 5, 4, 100, 200))
    (tmp_path / "archives/N9.zip").write_bytes(b"not wanted")
    keyed.create(made(spark, ["1307"], "BEFORE"), str(tmp_path / "records"), 16, stats={"ordinaryFallbackAdded": 7})
    at = refresh.Places(*(str(tmp_path / n) for n in ("list.csv", "index", "archives", "records", "missing", "status")))
    assert refresh.refresh(spark, at, "2024-06-10", generated_at="now") == {"companies": 6, "facts": 20, "failures": 1, "ordinaryFallbackAdded": 1, "ordinaryLatestRefreshed": 1, "ordinaryRefreshFailures": 1}
    got = {r.code: r.record for r in keyed.read(spark, at.snapshot).collect()}
    assert {c: r.documentId for c, r in got.items()} == {"1301": "N1", "1307": "N5"} and got["1301"].metrics["operatingMargin"].value == 9.0 and got["1307"].periodEnd == "2024-04-30"
    report = whole(tmp_path / "missing")
    assert report["generatedAt"] == "now" and {k: [c["code"] for c in v] for k, v in report["reasons"].items()} == {"ordinary-company": ["1302", "1303"], "new-listing-or-recent-ipo": ["130A"], "separate-model": ["1305"]}
    status = spark.read.json(at.status).first()
    assert (status.generatedAt, status.companies, status.targetCompanies, status.ordinaryFallbackAddedTotal, status.ordinaryLatestRefreshedTotal, status.ordinaryRefreshFailuresTotal) == ("now", 2, 6, 8, 1, 1)
    # the archive that was broken arrives; nothing else is new
    (tmp_path / "archives/N2.zip").write_bytes(sheet(10, 1, 1, 5, 9))
    assert refresh.refresh(spark, at, "2024-06-10", generated_at="later")["ordinaryFallbackAdded"] == 1
    assert spark.read.json(at.status).first().generatedAt == "later" and keyed.manifest(spark, at.snapshot)["stats"] == {"ordinaryFallbackAdded": 9, "ordinaryLatestRefreshed": 1, "ordinaryRefreshFailures": 1}
    # as a view's columns
    assert {r.code for r in records.flat(keyed.read(spark, at.snapshot)).collect()} == {"1301", "1302", "1307"}


def test_cut_off(spark):
    rows = [(f"c{i}", 0, f"D{i}", i // 3, i % 3, "failed" if i % 4 == 1 else rules.ADDED_POLICY) for i in range(12)]
    scan = spark.createDataFrame(rows, "code string, nth int, doc_id string, day_offset int, day_seq int, policy string")
    assert sorted(r.doc_id for r in choose.cut_off(scan, 3).collect()) == ["D0", "D1", "D2", "D3"]
    assert choose.cut_off(scan, None).count() == choose.cut_off(scan, 50).count() == 12
    totals = choose.counted_run(scan, spark.createDataFrame([("c0",), ("z",)], "code string"), spark.sql("select 1 as added, 2 as refreshed, 3 as failures")).first()
    assert tuple(totals) == (10, 2, 6, 10)
