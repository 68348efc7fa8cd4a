"""Company listings: the exchange's sheet as CSV (S1), and the company table inside a text bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def find_column(columns: list[str], *needles: str) -> str:
    """The first header that contains all needles."""
    found = next((c for c in columns if all(n in c for n in needles)), None)
    if found is None:
        raise KeyError(f"no header contains {needles}")
    return found


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """seq, code, name, market, industry as in the sheet, all text. seq follows file and line order without a global sort:
    it grows along the file, with gaps where Spark splits it."""
    sheet = spark.read.csv(path, header=True, inferSchema=False)
    names = {"code": ("コード",), "name": ("銘柄名",), "market": ("市場",), "industry": ("33業種",)}
    picked = [F.col(f"`{find_column(sheet.columns, *n)}`").alias(k) for k, n in names.items()]
    return sheet.select(F.monotonically_increasing_id().alias("seq"), *picked)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """seq, code, name, market, industry from every {code:`..`,name:`..`,market:`..`,industry:`..`} of a text file; entries with an empty
    field are none."""
    one = r"\{code:`([^`]+)`,name:`([^`]+)`,market:`([^`]+)`,industry:`([^`]+)`\}"
    text = spark.read.text(path, wholetext=True)
    columns = ("code", "name", "market", "industry")
    fields = F.arrays_zip(*(F.regexp_extract_all("value", F.lit(one), F.lit(i + 1)).alias(c) for i, c in enumerate(columns)))
    rows = text.select(F.posexplode(fields).alias("seq", "x"))
    return rows.select(F.col("seq").cast("long").alias("seq"), *(F.col(f"x.{c}").alias(c) for c in columns))
