"""Values at and around each threshold."""

import random

import pytest
from ledgerlake.functions import kpi, rules, scalar
from ledgerlake.operators import universe
from pyspark.sql import functions as F


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


def test_parse_number(spark):
    texts = [" 1,234.5 ", "　-7　", "", "nan", "Infinity", "1e400", "1_000", "１２３", "1.0d", "+.5", "5.", None, "1 2", "0x1f"]
    got = values(spark, [(t,) for t in texts], "t string", scalar.parse_number(F.col("t")))
    assert got == [1234.5, -7.0, None, None, None, None, 1000.0, 123.0, None, 0.5, 5.0, None, None, None]


def test_context_bucket(spark):
    refs = ["CurrentYearDuration", "CurrentYearInstant", "PriorYearDuration_Member", "prioryearinstant", "Prior1YearDuration", "FilingDateInstant", "CurrentQuarterDuration", "", None]
    got = values(spark, [(r,) for r in refs], "r string", scalar.context_bucket(F.col("r")))
    assert got == ["current_duration", "current_instant", "previous_duration", "previous_instant", None, None, "current_duration", None, None]
    assert values(spark, [("Prior1YearDuration",)], "r string", scalar.context_bucket(F.col("r"), "prior1?year")) == ["previous_duration"]


def test_rounding_and_ratios(spark):
    rnd = random.Random(1)
    numbers = [1.005, -2.5, 2.675, -2.675, 0.125, -0.125, 0.375, 1e300, -1e15, 0.0, 1e-320, *(rnd.randrange(-(10**7), 10**7) / 1000 for _ in range(4000)), *(rnd.randrange(-(10**6), 10**6) / 8 for _ in range(500)), *(rnd.uniform(-1e9, 1e9) for _ in range(500))]
    assert values(spark, [(x,) for x in numbers] + [(None,)], "x double", scalar.round2(F.col("x"))) == [*(round(x, 2) for x in numbers), None]
    assert values(spark, [(-0.25,), (0.25,)], "x double", scalar.round1(F.col("x"))) == [-0.2, 0.3]
    rows = [(1.0, 3.0), (1.0, 0.0), (None, 2.0), (1.0, None)]
    assert values(spark, rows, "n double, d double", scalar.pct(F.col("n"), F.col("d"))) == [33.33, None, None, None]
    assert values(spark, rows, "n double, d double", scalar.growth(F.col("n"), F.col("d"))) == [-66.67, None, None, None]


@pytest.mark.parametrize("name", rules.KPIS)
def test_status_at_thresholds(spark, name):
    normal, good, more = rules.STATUS[name]
    step = 1e-6 if more else -1e-6
    rows = [(good,), (good - step,), (normal,), (normal - step,), (None,)]
    assert values(spark, rows, f"v_{name} double", kpi.status(name)) == ["good", "normal", "normal", "warning", "unknown"]


def test_validity(spark):
    inf, nan = float("inf"), float("nan")
    assert values(spark, [(-100.0,), (-100.1,), (nan,), (inf,)], "x double", kpi.valid("revenueGrowth", F.col("x"))) == [-100.0, None, None, None]
    assert values(spark, [(0.0,), (-0.1,)], "x double", kpi.valid("debtRatio", F.col("x"))) == [0.0, None]
    assert values(spark, [(100.0,), (100.1,), (-100.0,)], "x double", kpi.valid("equityRatio", F.col("x"))) == [100.0, None, -100.0]


def test_usable_previous(spark):
    rows = [(135.0, 100.0), (65.0, 100.0), (136.0, 100.0), (1.0, 0.0), (1.0, None), (-1.0, 1.0)]
    got = values(spark, rows, "c double, p double", kpi.usable_previous(F.col("c"), F.col("p")))
    assert got[1:] == [True, False, False, False, False] and got[0] == (abs(135.0 / 100 - 1) <= 0.35)


def frame(spark, history=(), **kpis):
    schema = ", ".join(f"{x}_{k} double" for k in rules.KPIS for x in "vp") + ", history array<double>"
    row = [kpis.get(f"{x}_{k}") for k in rules.KPIS for x in "vp"]
    return kpi.analysed(spark.createDataFrame([(*row, list(history))], schema)).first()


def test_warnings_and_strengths(spark):
    w = rules.WARNINGS
    assert frame(spark, v_revenueGrowth=3.1, v_operatingMargin=5.0, p_operatingMargin=5.9).warnings == [w[0]]
    assert frame(spark, v_revenueGrowth=3.1, v_operatingMargin=5.0, history=[1.0, 5.9, 9.0]).warnings == [w[0]]
    assert frame(spark, v_revenueGrowth=3.0, v_operatingMargin=5.0, p_operatingMargin=9.0).warnings == []
    assert frame(spark, v_netMargin=10.0, v_operatingCfMargin=5.4).warnings == [w[1]]
    assert frame(spark, v_inventoryGrowth=8.1, v_receivablesGrowth=8.1, v_revenueGrowth=0.0).warnings == [w[2], w[3]]
    assert frame(spark, v_inventoryGrowth=8.1).warnings == []
    assert frame(spark, v_equityRatio=24.9, v_debtRatio=2.6, v_roe=18.1).warnings == [w[4], w[5], w[7]]
    assert frame(spark, v_per=51.0).warnings == [] and frame(spark, v_per=51.0, v_pbr=1.0).warnings == [w[6]]
    assert frame(spark, history=[3.0, 2.0, 1.0, 9.0]).warnings == [w[8]] and frame(spark, history=[3.0, 2.0]).warnings == []
    s = rules.STRENGTHS
    assert frame(spark).strengths == [rules.NO_STRENGTH]
    all_good = dict(v_revenueGrowth=10.0, v_operatingMargin=15.0, v_roe=14.0, v_equityRatio=55.0, v_operatingCfMargin=12.0, v_netCash=200.0, v_per=13.0, v_pbr=1.5)
    assert frame(spark, **all_good).strengths == list(s[:4]) and frame(spark, v_per=13.0, v_pbr=1.5).strengths == [s[6]]


def test_scores(spark):
    none = frame(spark)
    assert none.s_overall == 50 and none.s_valuation == 50 and none.analysis_comment == rules.FEW_KPIS_COMMENT
    top = frame(spark, v_revenueGrowth=20.0, v_inventoryGrowth=0.0, v_receivablesGrowth=0.0)
    assert top.s_growth == 100 and top.s_overall == 100
    cash = frame(spark, v_operatingCfMargin=22.0, v_netCash=800.0, v_per=55.0, v_pbr=6.0)
    assert cash.s_cashGeneration == 100 and cash.s_valuation == 0
    assert abs(cash.s_overall - 100 * 0.2 / 0.34) < 1e-9
    better = frame(spark, v_operatingMargin=9.0, p_operatingMargin=8.0, v_operatingCfMargin=10.0)
    assert better.analysis_comment == rules.IMPROVING_COMMENT


def test_rating(spark):
    got = values(spark, [(80.0,), (79.9,), (65.0,), (50.0,), (49.9,)], "s double", scalar.rating(F.col("s")))
    assert got == ["Excellent", "Strong", "Strong", "Neutral", "Watch"]


def test_listing_and_classes(spark):
    rows = [
        (" 1301 ", "A社", "プライム", "化学"), ("130A", "B", "グロース", ""), ("25935", "C", "プライム", "nan"), ("13", "D", "x", "y"), ("13AB", "E", "x", "y"),
        ("1302", "上場投信F", "x", "y"), ("1303", "コンクリート", "x", "y"), ("1304", "G", "ETF・ETN", "y"), ("nan", "H", "x", "y"), ("1305", "　", "x", "y"), (None, "I", "x", "y"),
    ]
    sheet = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, code string, name string, market string, industry string")
    got = [(r.code, r.industry) for r in universe.listed(sheet).orderBy("seq").collect()]
    assert got == [("1301", "化学"), ("130A", "不明"), ("25935", "不明")]
    rows = [("1301", "A", "x", "化学"), ("130A", "A", "x", "化学"), ("25935", "A", "x", "化学"), ("1301", "A", "x", "銀行業"), ("1301", "A優先株", "x", "化学"), ("1301", "A", None, None)]
    kinds = values(spark, rows, "code string, name string, market string, industry string", universe.company_class())
    assert kinds == [rules.ORDINARY, rules.NEW_LISTING, rules.SEPARATE, rules.SEPARATE, rules.SEPARATE, rules.ORDINARY]


def test_status_row(spark):
    report = spark.createDataFrame([(3919, 3677, 250, 73, 171, 6)], "target_companies long, implemented_companies long, missing_companies long, ordinary_missing long, new_listing long, separate_model long")
    r = universe.with_status(report).first()
    assert r.coverage_ratio == 93.82 and "対象3,919社中3,677社を取得済み、未取得250社。普通企業の未取得は73社。" in r.message
    empty = spark.createDataFrame([(0, 5, 0, 0, 0, 0)], report.schema)
    assert universe.with_status(empty).first().coverage_ratio == 0 and universe.with_status(empty).first().missing_companies == 0
    old = spark.sql("select 1 as mode, 9 as coverage_ratio")
    assert universe.carried(old, universe.with_status(report)).select("mode", "coverage_ratio").first() == (1, 93.82)


def test_display(spark):
    assert values(spark, [(1234.5,), (-3.0,), (None,)], "x double", scalar.value_text(F.col("x"), "億円")) == ["+1,234.5億円", "-3億円", "—"]
    assert values(spark, [(5.0, 4.0), (5.0, None)], "x double, p double", scalar.delta_text(F.col("x"), F.col("p"), "%")) == ["+1pt", "前年差なし"]
    assert values(spark, [(2e8,), (15000.0,), (999.0,), (None,)], "x double", scalar.volume_text(F.col("x"))) == ["2億株", "1.5万株", "999株", "出来高なし"]
    assert values(spark, [(99.5,), (1234.4,), (1234.5,)], "x double", scalar.yen_text(F.col("x"))) == ["￥99.5", "￥1,234", "￥1,235"]


def test_dashboard_prefers_the_status_row(spark):
    from ledgerlake.operators import screen

    view = spark.createDataFrame([("EDINET", True, 60.0), ("EDINET", False, 40.0), ("unavailable", False, 0.0)], "data_source string, has_warning boolean, s_overall double")
    assert tuple(screen.dashboard(view).first()) == (3, 2, 1, 50.0, 2 / 3 * 100)
    status = spark.sql("select 3919L as target_companies, cast(null as long) as companies, 93.82D as coverage_ratio")
    assert tuple(screen.dashboard(view, status).first()) == (3919, 2, 1, 50.0, 93.82)
    assert tuple(screen.dashboard(view.limit(0)).first()) == (0, 0, 0, 0.0, 0.0)
