"""The search index against the scan, pages against a sort, and facts cut down before they are shuffled."""

from ledgerlake.operators import facts, screen, search
from ledgerlake.sources import store
from pyspark.sql import functions as F
from test_archives import files_read


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    names = ["トヨタ自動車", "Ｔｏｙｏｔａ　Motor", "日本 電信", "ABC", "ab", "a", "", "ｱｲｳｴｵ", "aaaaaaa", "aXbXc", "abcabd", "ﾞ"]
    view = spark.createDataFrame([(i, f"{1300 + i}" if i % 3 else f"13{i % 10}A", n, "プライム") for i, n in enumerate(names)], "seq long, code string, name string, market string").withColumn("has_warning", F.lit(False))
    view = screen.with_folded(view)
    index = store.stored(spark, "grams", [], lambda: search.postings(view), "gram", 8)
    for needle in ["a", "A", "ト", "ト ", "自動車", "toyota m", "ＴＯＹＯＴＡ", "motor", "ア", "アイウエ", "ab", "abc", "abca", "aaaaaaaa", "aaaa", "130", "13", "1", "30a", "　", "", "zz", "xbx", "電信", "日本 電"]:
        want = {r.seq for r in screen.screened(view, needle).collect()}
        assert {r.seq for r in search.searched(view, index, needle).collect()} == want, needle
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # plans name the buckets that are read only then
    text = search.found(index, {"name": "xbx"})._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in text


def test_pages(spark, tmp_path):
    rows = [(i, f"{i % 700:04d}" + ("A" if i % 13 == 0 else ""), "EDINET" if i % 4 else "unavailable", float(i * 7919 % 101)) for i in range(1000)]
    view = spark.createDataFrame(rows, "seq long, code string, data_source string, s_overall double").repartition(5)
    for order in ("score-desc", "code-asc"):
        path = str(tmp_path / order)
        search.page_index(view, path, order)
        index = search.opened_index(spark, path)
        want = [r.seq for r in view.orderBy(*screen.sort_key(order)).collect()]
        for n in (1, 2, 17, 33, 34, 35):
            assert [(r.place, r.seq) for r in search.indexed_page(index, n).collect()] == [(30 * (n - 1) + k, s) for k, s in enumerate(want[30 * (n - 1) : 30 * n])]
        assert files_read(search.indexed_page(index, 17)) <= 2 and index[0].columns[:-1] == [*view.columns, "_nth"]


def test_facts_of_wanted_documents(spark):
    rows = spark.range(50_000).select(F.concat(F.lit("D"), F.col("id") % 5000).alias("doc_id"), F.col("id").alias("value"))
    wanted = spark.range(0, 5000, 50).select(F.concat(F.lit("D"), "id").alias("doc_id"))
    for most in (1000, 10):
        cut = facts.of_documents(rows, wanted, most)
        assert cut.columns == rows.columns and cut.count() == 1000 and cut.filter(F.substring("doc_id", 2, 9).cast("int") % 50 != 0).count() == 0
    # sent ids: facts of other documents aren't shuffled; bitmaps: few of them are
    plan = facts.of_documents(rows, wanted).groupBy("doc_id").count()._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("BroadcastHashJoin")
    assert above.count("Exchange") == 1 and below.count("Exchange hashpartitioning") == 1  # the groups', and that of the distinct ids
    before = facts.of_documents(rows, wanted, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in before.lower() or "bitmapconstructagg" in before.lower()
