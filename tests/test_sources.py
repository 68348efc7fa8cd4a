"""Files that the jobs read and write."""

import io
import json
import zipfile

import pytest
from ledgerlake.functions import kpi
from ledgerlake.operators import facts, records, screen, universe
from ledgerlake.operators import filings as choose
from ledgerlake.sources import filings, listing, snapshots
from pyspark.sql import functions as F


def test_listing_sheet(spark, tmp_path):
    (tmp_path / "a.csv").write_text("日付,コード,銘柄名,市場・商品区分,33業種コード,33業種区分\n1,1301,極洋,プライム,50,水産・農林業\n1,130A,甲,グロース,3250,医薬品\n", encoding="utf-8")
    rows = listing.read_listing(spark, str(tmp_path / "a.csv")).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in rows] == [("1301", "極洋", "プライム", "50"), ("130A", "甲", "グロース", "3250")]
    with pytest.raises(KeyError):
        listing.find_column(["a", "b"], "コード")


def test_bundle(spark, tmp_path):
    (tmp_path / "b.js").write_text("x=[{code:`1`,name:`甲`,market:`m`,industry:`i`},{code:`2`,name:`乙`,market:`m`,industry:``},{code:`3`,name:`丁`,market:`m`,industry:`j`},{code:`1`,name:`丙`,market:`m`,industry:`i`}]", encoding="utf-8")
    rows = listing.read_bundle(spark, str(tmp_path / "b.js")).collect()
    assert [tuple(r) for r in rows] == [(0, "1", "甲", "m", "i"), (1, "3", "丁", "m", "j"), (2, "1", "丙", "m", "i")]


def test_filing_index(spark, tmp_path):
    day = {"results": [{"docID": "A", "secCode": None, "docTypeCode": "120"}, {"docID": "B", "secCode": "13010", "docTypeCode": "120", "submitDateTime": "2024-05-01 10:00"}]}
    (tmp_path / "2024-05-01.json").write_text(json.dumps(day))
    rows = filings.read_filing_index(spark, str(tmp_path)).orderBy("day_seq").collect()
    assert [(r.doc_id, r.sec_code, r.submit_ts, str(r.fetch_day), r.day_seq) for r in rows] == [("A", None, None, "2024-05-01", 0), ("B", "13010", "2024-05-01 10:00", "2024-05-01", 1)]


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def damaged(data):
    """An archive whose compressed bytes were changed in the middle."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        i = z.infolist()[0]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(i.filename, zipfile.ZipFile(io.BytesIO(data)).read(i.filename))
    b = bytearray(out.getvalue())
    b[60:90] = b"\xff" * 30
    return bytes(b)


def xbrl(*elements):
    return '<x xmlns:j="ns">' + "".join(f'<j:{t} contextRef="{c}">{v}</j:{t}>' for t, c, v in elements) + "</x>"


def test_archives(spark, tmp_path):
    good = xbrl(("NetSales", "CurrentYearDuration", "1,000"), ("NetSales", "CurrentYearDuration", "7"), ("ShortTermBorrowings", "CurrentYearInstant", "5"), ("LongTermBorrowings", "CurrentYearInstant", "6"), ("Assets", "FilingDateInstant", "9"), ("Assets", "CurrentYearInstant", "nan"))
    files = {
        "D1": archive({"XBRL/AuditDoc/a.xbrl": xbrl(("NetSales", "CurrentYearDuration", "99")), "XBRL/PublicDoc/b.xbrl": good}),
        "D2": archive({f"{i}.xbrl": xbrl(("NetSales", "CurrentYearDuration", str(i))) for i in range(5)}),
        "D3": b"not a zip",
        "D4": archive({"a.xbrl": "<x><unclosed>"}),
        "D5": archive({"readme.txt": "x"}),
        "D6": archive({"a.xbrl": xbrl(("NetSales", "CurrentYearDuration", "5")), "b.xbrl": "<x><unclosed>"}),
        "D7": damaged(archive({"a.xbrl": xbrl(*[("NetSales", "CurrentYearDuration", str(i * 7919)) for i in range(400)])})),
        "D8": archive({"a.xbrl": '<?xml version="1.0" encoding="no-such-encoding"?><x/>'}),
        "D9": archive({"a.XBRL": xbrl(("NetSales", "CurrentYearDuration", "8"))}),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    raw = filings.read_archives(spark, str(tmp_path)).persist()
    assert {r.doc_id for r in raw.filter("error is not null").collect()} == {"D3", "D4", "D6", "D7", "D8"}
    assert {r.doc_id for r in raw.filter("error is null").collect()} == {"D1", "D2"}
    assert raw.filter("doc_id = 'D2'").agg(F.countDistinct("member_idx")).first()[0] == 3
    parsed = facts.parsed_facts(raw).withColumn("place", F.struct("member_idx", "elem_idx"))
    got = sorted(tuple(r) for r in facts.picked_facts(parsed, "place").collect())
    assert got == [("D1", "interestBearingDebt", "current_instant", 11.0), ("D1", "revenue", "current_duration", 1000.0), ("D2", "revenue", "current_duration", 0.0)]
    only = filings.read_archives(spark, str(tmp_path), spark.createDataFrame([("D1",)], "doc_id string"))
    assert {r.doc_id for r in only.collect()} == {"D1"}
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.replace("contentType", "")
    raw.unpersist()


def test_snapshots(spark, tmp_path):
    record = {"code": "1", "documentId": "D", "metrics": {"roe": {"value": 1.5, "trend": [1.0]}}, "history": [{"year": "2023", "operatingMargin": 2.0}]}
    text = "﻿" + json.dumps({"generatedAt": "t", "stats": {"a": 1.0}, "records": {"1": record, "2": record, "3": {"metrics": {"roe": {"value": "@"}}}}}).replace('"@"', "-Infinity")
    (tmp_path / "f.json").write_text(text, encoding="utf-8")
    rows = {r.code: r.record for r in snapshots.read_records(spark, str(tmp_path / "f.json")).collect()}
    assert set(rows) == {"1", "3"} and rows["1"].metrics["roe"].value == 1.5 and rows["3"].metrics["roe"].value is None
    assert snapshots.read_records(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert snapshots.read_records(spark, str(tmp_path / "bad.json"), str(tmp_path / "f.json")).count() == 2
    market = {"quotes": {"1": {"close": 10.0, "previousClose": 9.0}}, "fundamentals": {"1": {"eps": 2.0}}}
    (tmp_path / "m.json").write_text(json.dumps(market))
    quotes, fundamentals = snapshots.read_market(spark, str(tmp_path / "m.json"))
    assert quotes.first().close == 10.0 and fundamentals.first().eps == 2.0


def test_writing(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, [1.0, inf], {"a": -inf, "b": 2.0}, (nan, "x"))], "i int, d double, l array<double>, m map<string,double>, s struct<d:double,t:string>")
    row = snapshots.finite_everywhere(df).first()
    assert row.i == 1 and row.d is None and row.l == [1.0, None] and row.m == {"a": None, "b": 2.0} and tuple(row.s) == (None, "x")
    snapshots.write_report(df.select("i"), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*"))) == 1


def test_folding(spark):
    rows = [("ＡＢＣ　ホールディングス",), ("abc",), ("ｱｲｳ",), (None,)]
    df = spark.createDataFrame(rows, "name string").withColumn("name_fold", screen.folded("name"))
    assert [r.name_fold for r in df.collect()] == ["abc ホールディングス", "abc", "アイウ", None]
    listed = df.withColumns({"code": F.lit("130A"), "market": F.lit("プライム（内国株式）"), "has_warning": F.lit(True)})
    found = lambda **k: screen.screened(listed, **k).count()
    assert found(query="130a") == found(query=" １３０Ａ") == found(query="") == 4 and found(query="ABC") == 2 and found(query="ａｂｃ ホール") == 1 and found(query="zzz") == 0
    assert found(market="プライム(内国") == 4 and found(market="ﾌﾟﾗｲﾑ", query="アイ") == 1 and found(market="グロース") == 0
    assert df.filter(screen.matches("abc")).count() == 2 and df.filter(screen.matches("アイ")).count() == 1 and df.filter(screen.matches("　 ")).count() == 4


def whole(folder):
    """The files of a folder one after another, as JSON."""
    return json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*"))))


def test_missing_report_and_status(spark, tmp_path):
    companies = spark.createDataFrame([(i, c, f"会社{i}", "プライム", "銀行業" if i == 3 else "化学") for i, c in enumerate(["1301", "130A", "1303", "1304", "1305"])], "seq long, code string, name string, market string, industry string")
    records = spark.createDataFrame([("1301",), ("9999",)], "code string")
    gone, report = universe.missing(companies, records), universe.missing_report(companies, records)
    snapshots.write_missing_report(report, gone, str(tmp_path / "missing"), "now")
    got = whole(tmp_path / "missing")
    assert [got[k] for k in ("generatedAt", "targetCompanies", "implementedCompanies", "missingCompanies", "ordinaryMissingCompanies", "newListingOrRecentIpo", "separateModelCompanies")] == ["now", 5, 2, 4, 2, 1, 1]
    assert {k: [c["code"] for c in v] for k, v in got["reasons"].items()} == {"new-listing-or-recent-ipo": ["130A"], "ordinary-company": ["1303", "1305"], "separate-model": ["1304"]}
    assert [c["code"] for c in got["missing"]] == ["130A", "1303", "1304", "1305"] and got["missing"][0] == {"code": "130A", "name": "会社1", "market": "プライム", "industry": "化学", "reason": "new-listing-or-recent-ipo"}
    assert set(got["policy"]) == {"ordinary-company", "new-listing-or-recent-ipo", "separate-model"}
    snapshots.write_missing_report(universe.missing_report(companies.limit(0), records), gone.limit(0), str(tmp_path / "none"))
    assert whole(tmp_path / "none")["reasons"] == {} and whole(tmp_path / "none")["missing"] == []

    stats = spark.sql("select map('ordinaryFallbackAdded', 7D) as s")
    before = spark.sql("select 'x' as mode, 12 as edinetBatchSize")
    aged = before.withColumn("generatedAt", F.lit("long ago"))
    assert universe.status_row(report, records, stats, aged, "now").first().generatedAt == "now" and universe.status_row(report, records, stats, aged).first().generatedAt > "2020"
    row = universe.status_row(report, records, stats, before).first()
    assert (row.mode, row.edinetBatchSize, row.tdnetOverlay, row.edinetMerged, row.companies, row.coverageRatio, row.ordinaryFallbackAddedTotal, row.ordinaryRefreshFailuresTotal) == ("jpx-universe-edinet-ordinary-autofill", 12, True, True, 2, 40.0, 7, 0)
    absent = spark.sql("select cast(null as long) as target_companies, cast(null as long) as implemented_companies, cast(null as long) as missing_companies, cast(null as long) as ordinary_missing, cast(null as long) as new_listing, cast(null as long) as separate_model")
    row = universe.status_row(absent, records, stats).first()
    assert (row.companies, row.targetCompanies, row.missingCompanies, row.coverageRatio) == (2, 0, 0, 0.0)


def test_from_listing_to_view_and_back(spark, tmp_path):
    """Companies without a record get one from their filing's archive; the snapshot is read back as a view."""
    companies = spark.createDataFrame([(0, "1301", "甲", "プライム", "化学"), (1, "1302", "乙", "プライム", "化学"), (2, "1303", "丙", "プライム", "小売業"), (3, "1304", "丁", "プライム", "化学")], "seq long, code string, name string, market string, industry string")
    old = {"code": "1303", "documentId": "OLD", "filedAt": "2024-01-01 09:00", "periodEnd": "2023-12-31", "source": "TDnet", "sourceUrl": "u", "metrics": {"roe": {"value": 15.26, "previousValue": 9.0, "trend": [1.0, 2.04, 15.26], "comparisonLabel": "前期差"}, "per": {"value": 11.0}, "equityRatio": {"value": 101.0}}, "history": [{"year": "2021", "operatingMargin": 4.0}, {"year": "2022", "operatingMargin": 5.0}], "valuation": {"eps": 10.0, "forecastEps": 20.0}}
    (tmp_path / "before.json").write_text(json.dumps({"generatedAt": "t", "stats": {"ordinaryFallbackAdded": 3}, "records": {"1303": old}}, ensure_ascii=False), encoding="utf-8")
    archives = tmp_path / "archives"
    archives.mkdir()
    sheet = xbrl(*((t, f"{y}{k}", str(v * f)) for y, f in (("CurrentYear", 1), ("PriorYear", 0.5)) for t, k, v in (("NetSales", "Duration", 1000), ("OperatingIncome", "Duration", 90), ("ProfitLoss", "Duration", 60), ("NetAssets", "Instant", 400), ("Assets", "Instant", 1000), ("BasicEarningsLossPerShare", "Duration", 25))))
    (archives / "N1.zip").write_bytes(archive({"PublicDoc/a.xbrl": sheet}))
    (archives / "N2.zip").write_bytes(b"broken")
    (archives / "N4.zip").write_bytes(archive({"PublicDoc/a.xbrl": xbrl(("NetSales", "CurrentYearDuration", "5"))}))
    listed = spark.createDataFrame([("N1", "13010", "120", "2024-06-01 09:00", "2024-03-31"), ("N2", "13020", "120", "2024-06-01 10:00", "2024-03-31"), ("N4", "13040", "120", "2024-06-01 10:00", "2024-03-31")], "doc_id string, sec_code string, doc_type_code string, submit_ts string, period_end string")
    listed = listed.withColumns({"submit_date": F.lit(None).cast("string"), "fetch_day": F.to_date(F.lit("2024-06-01")), "day_seq": F.substring("doc_id", 2, 1).cast("int")})

    held = snapshots.read_records(spark, str(tmp_path / "before.json"))
    targets = universe.missing(companies, held).select("code")
    found = choose.candidates(choose.annual_filings(choose.dated(listed, "2024-06-10"), companies), records.heads(held), targets)
    raw = filings.read_archives(spark, str(archives), found.select("doc_id"))
    place = facts.parsed_facts(raw.filter("error is null")).withColumn("place", F.struct("member_idx", "elem_idx"))
    documents = kpi.kpi_records(facts.wide_facts(place, "place"))
    failed = raw.filter("error is not null").select("doc_id", F.lit(True).alias("failed"))
    tried = found.join(documents.select("doc_id", F.lit(True).alias("whole")), "doc_id", "left").join(failed, "doc_id", "left").filter("whole or failed")
    scan = choose.scanned_filings(tried)
    taken = choose.latest_accepted(scan).join(listed.select(F.col("doc_id").alias("document_id"), "period_end"), "document_id")
    after = records.replaced(held, records.built(taken, documents, companies))
    totals = choose.run_totals(scan, after, spark.sql("select 3 as added, 0 as refreshed, 0 as failures")).first()
    assert tuple(totals) == (4, 0, 1, 2)
    snapshots.write_snapshot(after, str(tmp_path / "after"), {"ordinaryFallbackAdded": totals.added, "companies": totals.companies}, "2024-06-10")

    got = whole(tmp_path / "after")
    assert got["generatedAt"] == "2024-06-10" and set(got["records"]) == {"1301", "1303"} and got["stats"]["ordinaryFallbackAdded"] == 4
    new = got["records"]["1301"]
    assert new["metrics"] == {"revenueGrowth": {"value": 100.0}, "operatingMargin": {"value": 9.0, "previousValue": 9.0}, "netMargin": {"value": 6.0, "previousValue": 6.0}, "roe": {"value": 15.0, "previousValue": 15.0}, "equityRatio": {"value": 40.0, "previousValue": 40.0}}
    assert (new["documentId"], new["filedAt"], new["periodEnd"], new["history"], new["valuation"], new["quality"]) == ("N1", "2024-06-01 09:00", "2024-03-31", [], {"eps": 25.0}, {"policy": "ordinary-missing-edinet-fallback", "autoFilled": True, "parserVersion": 1})
    assert snapshots.read_stats(spark, str(tmp_path / "after")).first().s == {"ordinaryFallbackAdded": 4.0, "companies": 2.0}
    assert snapshots.read_stats(spark, str(tmp_path / "before.json")).first().s == {"ordinaryFallbackAdded": 3.0} and snapshots.read_stats(spark, str(tmp_path / "none")).first().s == {}

    quotes = spark.createDataFrame([("1301", 500.0, 490.0, 2.0, 9.0), ("1302", 5.0, None, None, None)], "code string, close double, previous_close double, change_percent double, volume double")
    fundamentals = spark.createDataFrame([], "code string, eps double, bps double, forecast_eps double")
    for path in ("after", "after"):
        back = snapshots.read_records(spark, str(tmp_path / path))
        view = screen.company_view(universe.numbered(companies), records.flat(back), quotes, fundamentals)
        v = {r.code: r for r in view.select("*", kpi.cell("roe").alias("roe"), kpi.cell("per").alias("per")).collect()}
    assert {c: r.data_source for c, r in v.items()} == {"1301": "EDINET", "1302": "unavailable", "1303": "TDnet", "1304": "unavailable"}
    assert (v["1301"].v_per, v["1301"].p_per, v["1301"].filed_at, v["1301"].period_end, v["1301"].volume, v["1302"].close) == (20.0, 19.6, "2024-06-01 09:00", "2024-03-31", 9.0, 5.0)
    assert v["1303"].v_per == 11.0 and v["1303"].v_equityRatio is None and v["1303"].live_kpis == 2 and v["1303"].prev_margin == 4.0 and v["1303"].source_url == "u"
    assert (v["1303"].roe.trend, v["1303"].roe.comparisonLabel, v["1303"].roe.previousValue) == ([1.0, 2.0, 15.3], "前期差", 9.0)
    assert (v["1303"].per.trend, v["1303"].per.comparisonLabel) == ([], "前年差") and (v["1301"].per.trend, v["1301"].per.comparisonLabel) == ([19.6, 20.0], "前日差")


def test_row_index(spark):
    seqs = [5, 1, 1 << 33, 70000, 70001, (1 << 33) + 9]
    got = universe.numbered(spark.createDataFrame([(s,) for s in seqs], "seq long")).collect()
    assert sorted((r.seq, r.row_index) for r in got) == [(s, i) for i, s in enumerate(sorted(seqs))]
