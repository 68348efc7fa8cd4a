"""Filing archives as a data source, and days of the index that aren't opened."""

import datetime
import io
import json
import random
import tracemalloc
import zipfile

from ledgerlake.operators import facts
from ledgerlake.operators import filings as choose
from ledgerlake.sources import archives, filings
from pyspark.sql import functions as F
from test_sources import archive, damaged, xbrl


def rows_of(df):
    return sorted((r.doc_id, r.member_idx, r.elem_idx, r.metric, r.bucket, r.value) for r in df.collect())


def test_facts_as_by_the_plain_way(spark, tmp_path):
    nested = '<x xmlns:j="ns"><g contextRef="CurrentYearDuration">1<j:Assets contextRef="CurrentYearInstant"> １,０００_0 <j:y/></j:Assets>7<j:NetSales contextRef="Prior1YearDuration">5</j:NetSales></g></x>'
    odd = xbrl(("NetSales", "CurrentYearDuration", "1_0"), ("NetSales", "PriorYearDuration", "-1.5e3"), ("Assets", "CurrentYearInstant", "　12,345　"), ("Assets", "PriorYearInstant", "1e999"), ("Equity", "PriorYearInstant", "1d"), ("Other", "CurrentYearInstant", "1"), ("Equity", "FilingDateInstant", "1"))
    files = {"D1": archive({"a/PublicDoc/b.xbrl": nested, "c.xbrl": odd}), "D2": archive({f"{i}.xbrl": odd for i in range(5)}), "D3": b"no zip", "D4": archive({"a.xbrl": odd, "b.xbrl": "<x><y>"}), "D5": archive({"r.txt": "x"}), "D6": damaged(archive({"a.xbrl": odd * 50}))}
    for name, data in files.items():
        (tmp_path / f"{name}.zip").write_bytes(data)
    raw = filings.read_archives(spark, str(tmp_path))
    want = rows_of(facts.parsed_facts(raw.filter("error is null")))
    assert len(want) == 10
    got = archives.archive_facts(spark, str(tmp_path), 3)
    assert rows_of(got.filter("error is null")) == want
    assert {r.doc_id for r in got.filter("error is not null").collect()} == {r.doc_id for r in raw.filter("error is not null").collect()} == {"D3", "D4", "D6"}
    names = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("doc_id"), "path", "length")
    by_rows = archives.facts_of(names, 3)
    assert rows_of(by_rows.filter("error is null")) == want and by_rows.filter("error is not null").count() == 3
    assert archives.facts_of(names.limit(0), 3).count() == 0 == archives.archive_facts(spark, str(tmp_path)).filter("doc_id = 'none'").count()


def test_planning(spark, tmp_path):
    draw = random.Random(4)
    sizes = [draw.choice([10, 100, 5000, 40_000]) for _ in range(300)]
    loads = [sum(sizes[i] for i in b) for b in archives.packed(sizes, 16)]
    assert len(loads) == 16 and max(loads) < 1.1 * sum(loads) / 16 and sorted(i for b in archives.packed(sizes, 16) for i in b) == list(range(300))
    assert archives.packed([], 4) == [] and archives.packed([5], 4) == [[0]]

    rows = spark.createDataFrame([(f"D{i}", f"/a/D{i}.zip", n) for i, n in enumerate(sizes)], "doc_id string, path string, length long")
    loads = [r.n for r in archives.dealt(rows, 16).groupBy("_task").agg(F.sum("length").alias("n")).collect()]
    assert len(loads) == 16 and sum(loads) == sum(sizes) and max(loads) <= sum(sizes) / 16 + max(sizes) and max(loads) < 2 * sum(sizes) / 16

    day = datetime.date(2024, 5, 1)
    for k in range(6):
        folder = tmp_path / f"fetch_day={day + datetime.timedelta(days=k)}"
        folder.mkdir()
        for n in range(4):
            (folder / f"D{k}{n}.zip").write_bytes(archive({"a.xbrl": xbrl(("NetSales", "CurrentYearDuration", f"{k}{n}"))}))
    (tmp_path / "fetch_day=2024-05-02" / "bad.zip").write_bytes(b"x")
    df = archives.archive_facts(spark, str(tmp_path), 4)
    got = df.filter((F.col("fetch_day") > day) & (F.col("fetch_day") <= day + datetime.timedelta(days=2))).collect()
    assert sorted(r.doc_id for r in got) == sorted(["bad", *(f"D{k}{n}" for k in (1, 2) for n in range(4))]) and {r.fetch_day.day for r in got} == {2, 3}
    assert [r.value for r in df.filter("doc_id in ('D33', 'D99') and fetch_day >= '2024-05-04'").collect()] == [33.0]
    # planning lists no other folder, and opens no other archive
    reader = archives.ArchivesReader(str(tmp_path), 4, "prioryear")
    left = list(reader.pushFilters([archives.EqualTo(("doc_id",), "D33"), archives.GreaterThan(("fetch_day",), day), archives.LessThan(("value",), 5.0)]))
    assert [f.attribute for f in left] == [("value",)] and [[f[0] for f in p.value[0]] for p in reader.partitions()] == [["D33"]]
    assert len(archives.listed(str(tmp_path), day, day)) == 4


def test_a_large_member_in_little_memory(tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("a.xbrl", "w") as out:
        out.write(b'<x xmlns:j="ns">')
        for i in range(60):
            out.write(b"".join(b'<j:NetSales contextRef="CurrentYearDuration">%d</j:NetSales><note contextRef="c"><p>%s</p></note>' % (i, b"text " * 20) for _ in range(4000 if i else 1)))
        out.write(b"</x>")
    tracemalloc.start()
    n = sum(1 for _ in archives.elements(zipfile.ZipFile(tmp_path / "big.zip").open("a.xbrl")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2 * (59 * 4000 + 1) and peak < 4 << 20, peak
    assert zipfile.ZipFile(tmp_path / "big.zip").getinfo("a.xbrl").file_size > 40 << 20


def files_read(df):
    """Files that the scans of an executed plan opened."""
    df = df.select("*")  # a plan of its own, as figures of one that has run before are reset
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_days_out_of_range_stay_closed(spark, tmp_path):
    for k in range(1, 31):
        day = {"results": [{"docID": f"D{k}", "secCode": "13010", "docTypeCode": "120"}]}
        (tmp_path / "named").mkdir(exist_ok=True)
        (tmp_path / "named" / f"documents-2024-04-{k:02d}.json").write_text(json.dumps(day))
        folder = tmp_path / "laid" / f"fetch_day=2024-04-{k:02d}"
        folder.mkdir(parents=True)
        (folder / "list.json").write_text(json.dumps(day))
    for layout in ("named", "laid"):
        index = filings.read_filing_index(spark, str(tmp_path / layout))
        near = choose.dated(index, "2024-04-25", lookback=5, refresh=3)
        assert sorted((r.doc_id, r.day_offset) for r in near.collect()) == sorted((f"D{25 - k}", k) for k in range(5))
        assert files_read(near) == 5 and files_read(index) == 30


def test_memory_file(tmp_path):
    """Archives are read through any file that can be sought in."""
    data = archive({"a.xbrl": xbrl(("NetSales", "CurrentYearDuration", "1"))})
    assert archives.wanted_facts(lambda: io.BytesIO(data)) == ([(0, 1, "revenue", "current_duration", 1.0)], None)
    (tmp_path / "a.zip").write_bytes(data)
    assert archives.wanted_facts(lambda: archives.opened(f"file://{tmp_path}/a.zip"))[0] == archives.wanted_facts(lambda: archives.opened(str(tmp_path / "a.zip")))[0]
