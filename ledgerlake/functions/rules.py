"""Lists, thresholds, weights and texts that results depend on."""

#: Industries whose companies need a model of their own.
SEPARATE_INDUSTRIES = ("銀行業", "保険業", "証券、商品先物取引業", "その他金融業")

#: Tokens of markets that list no ordinary companies.
MARKET_TOKENS = ("ETF", "ＥＴＦ", "ETN", "ＥＴＮ", "ETF・ETN", "REIT", "ＲＥＩＴ", "不動産投信")

#: Tokens of names that the listing leaves out.
LISTING_NAME_TOKENS = ("ETF", "ＥＴＦ", "ETN", "ＥＴＮ", "REIT", "リート", "投資法人", "上場投信", "投信", "指数連動", "インフラファンド")

#: Tokens of names that look like a security rather than a company.
SECURITY_NAME_TOKENS = (*LISTING_NAME_TOKENS, "種類株式", "優先株", "社債型")

UNKNOWN = "不明"
#: What a missing report says should be done about each reason.
POLICIES = {
    "ordinary-company": "Run the EDINET annual-report fallback parser first.",
    "new-listing-or-recent-ipo": "Keep in the universe and pick up automatically once annual data appears.",
    "separate-model": "Do not force company KPI scoring; use a bank, REIT, fund, or special-security model.",
}
#: Provenance of a record made from an annual report.
DOCUMENT_TYPE, PERIOD_TYPE, SOURCE, PARSER_VERSION = "AnnualSecuritiesReport", "annual", "EDINET", 1
SOURCE_URL, SOURCE_DETAIL = "https://disclosure2.edinet-fsa.go.jp/WZEK0040.aspx?", "EDINET有価証券報告書XBRL・未取得普通企業の自動補完"
ANNUAL_REPORT = "120"
LOOKBACK_DAYS, REFRESH_DAYS, BATCH_SIZE = 540, 90, 80
LEAST_KPIS = 3

SEPARATE, NEW_LISTING, ORDINARY = "separate-model", "new-listing-or-recent-ipo", "ordinary-company"
FAILED = "failed"
ADDED_POLICY, REFRESHED_POLICY = "ordinary-missing-edinet-fallback", "ordinary-edinet-latest-refresh"

#: Element names of each metric.
METRIC_TAGS = {
    "revenue": ("NetSales", "Revenue", "RevenueIFRS", "OperatingRevenue1", "OperatingRevenue2", "SalesRevenue"),
    "operatingIncome": ("OperatingIncome", "OperatingProfit"),
    "netIncome": ("ProfitLossAttributableToOwnersOfParent", "ProfitLoss", "NetIncomeLoss"),
    "totalAssets": ("Assets", "TotalAssets"),
    "equity": ("NetAssets", "Equity", "EquityAttributableToOwnersOfParent"),
    "operatingCashFlow": ("NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities"),
    "inventories": ("Inventories",),
    "receivables": ("NotesAndAccountsReceivableTrade", "TradeAndOtherReceivables"),
    "cash": ("CashAndDeposits", "CashAndCashEquivalents"),
    "interestBearingDebt": ("InterestBearingDebt", "ShortTermBorrowings", "LongTermBorrowings", "BondsPayable"),
    "eps": ("BasicEarningsLossPerShare", "BasicEarningsLossPerShareIFRS"),
    "bps": ("NetAssetsPerShare", "EquityAttributableToOwnersOfParentPerShare"),
}
SUMMED_METRIC = "interestBearingDebt"
BUCKETS = ("current_duration", "current_instant", "previous_duration", "previous_instant")

#: The KPIs, in order, with their unit and the value that stands for an absent one in scores.
KPIS = {
    "revenueGrowth": ("%", 0.0),
    "operatingMargin": ("%", 5.0),
    "netMargin": ("%", 3.0),
    "roe": ("%", 8.0),
    "equityRatio": ("%", 40.0),
    "operatingCfMargin": ("%", 5.0),
    "debtRatio": ("倍", 1.0),
    "netCash": ("億円", 0.0),
    "inventoryGrowth": ("%", 0.0),
    "receivablesGrowth": ("%", 0.0),
    "per": ("倍", 20.0),
    "pbr": ("倍", 1.5),
}
#: Fixed values: (normal, good, whether more is better) of each KPI.
STATUS = {
    "revenueGrowth": (3.0, 10.0, True),
    "operatingMargin": (5.0, 12.0, True),
    "netMargin": (2.0, 8.0, True),
    "roe": (7.0, 12.0, True),
    "equityRatio": (30.0, 50.0, True),
    "operatingCfMargin": (4.0, 10.0, True),
    "debtRatio": (1.5, 0.8, False),
    "netCash": (0.0, 180.0, True),
    "inventoryGrowth": (15.0, 7.0, False),
    "receivablesGrowth": (15.0, 7.0, False),
    "per": (35.0, 18.0, False),
    "pbr": (3.0, 1.5, False),
}
#: Comments of each KPI for good, normal and warning.
COMMENTS = {
    "revenueGrowth": ("成長ペースが強い", "緩やかな成長", "成長鈍化を確認"),
    "operatingMargin": ("高い収益力", "標準的な水準", "採算性に注意"),
    "netMargin": ("最終利益も堅調", "利益は安定圏", "利益の薄さに注意"),
    "roe": ("資本効率が良好", "標準的な効率", "資本効率に課題"),
    "equityRatio": ("財務余力が厚い", "一定の安定性", "財務耐性を確認"),
    "operatingCfMargin": ("現金創出力が強い", "安定したCF", "利益の質を確認"),
    "debtRatio": ("負債負担が軽い", "許容範囲の負債", "返済負担に注意"),
    "netCash": ("手元流動性が豊富", "資金余力は中立", "実質有利子負債"),
    "inventoryGrowth": ("在庫管理は良好", "売上と概ね連動", "在庫積み上がり"),
    "receivablesGrowth": ("回収状況は良好", "売上と概ね連動", "回収条件を確認"),
    "per": ("利益比で割安", "市場平均圏", "期待先行の水準"),
    "pbr": ("純資産比で割安", "妥当な評価", "資産比で高評価"),
}
NO_DATA_COMMENT = "開示データから取得できません"
YEAR_LABEL, DAY_LABEL = "前年差", "前日差"

#: Terms of each score: (weight, expression of KPIs, low, high); a low above the high turns the scale.
SCORES = {
    "growth": ((0.7, ("revenueGrowth",), -8.0, 20.0), (0.15, ("inventoryGrowth", "revenueGrowth"), 18.0, -8.0), (0.15, ("receivablesGrowth", "revenueGrowth"), 18.0, -8.0)),
    "profitability": ((0.45, ("operatingMargin",), 0.0, 24.0), (0.2, ("netMargin",), -2.0, 16.0), (0.35, ("roe",), 2.0, 22.0)),
    "safety": ((0.6, ("equityRatio",), 15.0, 75.0), (0.4, ("debtRatio", None), 0.2, 3.5)),
    "cashGeneration": ((0.75, ("operatingCfMargin",), -2.0, 22.0), (0.25, ("netCash",), -600.0, 800.0)),
    "valuation": ((0.55, ("per", None), 8.0, 55.0), (0.45, ("pbr", None), 0.6, 6.0)),
}
#: Weight of a score in the overall one, and the KPIs of which it needs one.
OVERALL = {
    "growth": (0.22, ("revenueGrowth",)),
    "profitability": (0.24, ("operatingMargin", "roe")),
    "safety": (0.20, ("equityRatio", "debtRatio")),
    "cashGeneration": (0.20, ("operatingCfMargin", "netCash")),
    "valuation": (0.14, ("per", "pbr")),
}
NEUTRAL = 50.0
RATINGS = ((80.0, "Excellent"), (65.0, "Strong"), (50.0, "Neutral"))
LOWEST_RATING = "Watch"
BANDS = ((70.0, "high"), (50.0, "mid"))

#: Texts of the nine warnings, in order.
WARNINGS = (
    "売上は伸びていますが、営業利益率が低下しています",
    "純利益は黒字ですが、営業CFが弱い状態です",
    "棚卸資産の増加率が売上成長率を大きく上回っています",
    "売掛金の増加率が売上成長率を大きく上回っています",
    "自己資本比率が低く、財務余力を確認したい状態です",
    "有利子負債倍率が高い水準です",
    "PERまたはPBRが極端に高い水準です",
    "ROEは高い一方、自己資本比率が低い状態です",
    "営業利益率が3年連続で低下しています",
)
#: Texts of the seven strengths, in order, and of none.
STRENGTHS = ("2桁の売上成長を維持", "高い営業利益率", "資本効率が良好", "厚い自己資本", "キャッシュ創出力が強い", "ネットキャッシュが豊富", "バリュエーションに割安感")
NO_STRENGTH = "業績は概ね安定圏で推移"
MOST_STRENGTHS = 4
#: Analysis comments in order of priority; the keys are what a warning must contain.
IMPROVING_COMMENT = "営業利益率と営業CFマージンが改善しており、収益性とキャッシュ創出力は良好です。"
WARNING_COMMENTS = {
    "棚卸資産": "棚卸資産の増加率が売上成長率を上回っています。在庫回転と需要見通しを確認したい局面です。",
    "営業CF": "純利益は黒字ですが営業CFが弱く、運転資本を含めて利益の質を確認したい状態です。",
    "営業利益率": "売上は伸びていますが営業利益率が低下しています。コスト増や価格転嫁の進捗に注意が必要です。",
}
FEW_KPIS_COMMENT = "取得できた開示項目が限られています。未取得KPIは判断不能として、原資料もあわせて確認してください。"
DEFAULT_COMMENT = "主要KPIは大きな偏りなく推移しています。次回決算では成長率と利益率の持続性を確認したい状態です。"
UNAVAILABLE_COMMENT = "EDINET・TDnetからこの企業の比較可能な財務データを取得できていないため、分析コメントは生成していません。"

#: Groups that an industry name stands for, then those found in a company's name.
GROUP_OF_INDUSTRY = {"銀行業": "銀行", "小売業": "小売", "電気・ガス業": "電力・インフラ"}
GROUP_OF_NAME = {
    "防衛・重工業": "三菱重工|川崎重工|ＩＨＩ|IHI|日本製鋼所|新明和",
    "半導体製造装置": "東京エレクトロン|ディスコ|アドバンテスト|ＳＣＲＥＥＮ|レーザーテック|ＫＯＫＵＳＡＩ",
}
#: Three themes of each group, and of any other.
THEMES = {
    "銀行": ("金利正常化", "地方創生", "高配当"),
    "小売": ("インバウンド", "省人化", "消費回復"),
    "防衛・重工業": ("防衛", "宇宙", "エネルギー安全保障"),
    "半導体製造装置": ("AI半導体", "半導体国産化", "データセンター"),
    "電力・インフラ": ("再生可能エネルギー", "GX", "インフラ更新"),
    "情報・通信業": ("生成AI", "DX", "サイバーセキュリティ"),
    "医薬品": ("創薬", "ヘルスケア", "高齢化"),
    "化学": ("素材革新", "EV", "脱炭素"),
    "食料品": ("値上げ", "海外展開", "健康志向"),
    "陸運業": ("物流効率化", "自動化", "EC"),
    "海運業": ("運賃市況", "物流網", "株主還元"),
    "空運業": ("インバウンド", "旅客需要", "燃料価格"),
    "倉庫・運輸関連業": ("物流効率化", "自動化", "EC"),
    "機械": ("設備投資", "自動化", "海外展開"),
    "電気機器": ("AI", "半導体", "データセンター"),
    "輸送用機器": ("EV", "自動運転", "海外展開"),
    "建設業": ("国土強靭化", "再開発", "人手不足"),
    "不動産業": ("金利", "再開発", "インバウンド"),
    "サービス業": ("人材不足", "DX", "消費回復"),
}
OTHER_THEMES = ("資本効率", "収益改善", "業界再編")

#: Names of the 33 industries by code.
INDUSTRY_NAMES = {
    "50": "水産・農林業", "1050": "鉱業", "2050": "建設業", "3050": "食料品", "3100": "繊維製品", "3150": "パルプ・紙", "3200": "化学",
    "3250": "医薬品", "3300": "石油・石炭製品", "3350": "ゴム製品", "3400": "ガラス・土石製品", "3450": "鉄鋼", "3500": "非鉄金属",
    "3550": "金属製品", "3600": "機械", "3650": "電気機器", "3700": "輸送用機器", "3750": "精密機器", "3800": "その他製品",
    "4050": "電気・ガス業", "5050": "陸運業", "5100": "海運業", "5150": "空運業", "5200": "倉庫・運輸関連業", "5250": "情報・通信業",
    "6050": "卸売業", "6100": "小売業", "7050": "銀行業", "7100": "証券・商品先物取引業", "7150": "保険業", "7200": "その他金融業",
    "8050": "不動産業", "9050": "サービス業",
}

COMPARED_SCORES = ("overall", "growth", "profitability", "safety", "cashGeneration", "valuation")
#: KPIs that are compared, and whether more is better.
COMPARED_KPIS = {"revenueGrowth": True, "operatingMargin": True, "roe": True, "equityRatio": True, "operatingCfMargin": True, "per": False, "pbr": False, "debtRatio": False}
MOST_COMPARED = 5
PAGE_SIZE = 30
