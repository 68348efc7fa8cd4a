"""Tables that are written once: buckets, plans without exchanges, and what makes them be written anew."""

import os
import shutil

from ledgerlake.plans import queries, views
from ledgerlake.sources import store
from pyspark.sql import functions as F


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_view_without_exchange(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables beyond any broadcast are joined
    joined = views.joined_view(spark, sf)
    assert "Exchange" not in plan(joined.select("code", "s_overall", "v_per")) and joined.count() == views.company_view(spark, sf).count()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    view = views.company_view(spark, sf)
    again = views.company_view(spark, sf)
    assert "Exchange" not in plan(view.groupBy("code").count()) and view.inputFiles() == again.inputFiles()
    # twenty queries read it and don't work it out again
    for name in ("overall_score", "warnings", "valuation_kpis", "movers", "top_scores"):
        text = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in text and "Aggregate" not in text and "lineitem" not in text, name
    assert {"name_fold", "code_fold", "market_fold"} <= set(view.columns)
    text = queries.QUERIES["screen_filter"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in text and "folded" not in text


def test_stored_anew_when_inputs_change(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.read.parquet(path)

    spark.range(10).withColumn("k", F.col("id") % 3).write.parquet(path)
    one = store.stored(spark, "some table", [path], make, "k", 4)
    assert one.count() == 10 and store.stored(spark, "some table", [path], make, "k", 4).count() == 10 and len(made) == 1
    assert "Exchange" not in plan(one.groupBy("k").count())
    shutil.rmtree(path)
    spark.range(25).withColumn("k", F.col("id") % 3).write.parquet(path)
    assert store.stored(spark, "some table", [path], make, "k", 4).count() == 25 and len(made) == 2
    assert store.shared_folder(spark).startswith("file:") and os.path.exists(path)


def test_tables_of_companies_are_not_sent(spark, sf):
    """Lists and the view grow with the companies: no join but that with the nations sends a side through the driver."""
    made = {n: queries.QUERIES[n](spark, sf) for n in ("watchlist", "compare_best", "compare_pivot", "compare_candidates")}
    for name, df in (made | {"view": views.joined_view(spark, sf).select("code", "s_overall", "v_per")}).items():
        assert not [line for line in plan(df).splitlines() if "BroadcastHashJoin" in line and "n_nationkey" not in line], name
