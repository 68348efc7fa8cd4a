"""The place of each row in an order over all of them, found without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .store import new_folder


def stored_in_order(df: DataFrame, order: list, path: str, folders: bool = False) -> DataFrame:
    """df written to path in ranges of an order, sorted in each, with _part (the range) and _nth (the place in it, from 0); each range may have a
    folder of its own, so that readers of some open no other."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.select(*df.columns, F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_nth"))
    (placed.write.partitionBy("_part") if folders else placed.write).parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def starts(placed: DataFrame) -> DataFrame:
    """_part, rows and first (the rows before it) of each range: as many rows as there are ranges."""
    counts = placed.groupBy("_part").agg(F.count("*").alias("rows"))
    return counts.select("_part", "rows", F.coalesce(F.sum("rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))


def numbered_by(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with the place of each row (from 0) in an order."""
    placed = stored_in_order(df, order, new_folder(df.sparkSession, "placed"))
    # one row a range, so the broadcast is bounded by the number of tasks
    return placed.join(F.broadcast(starts(placed)), "_part").select(*df.columns, (F.col("first") + F.col("_nth")).alias(name))
