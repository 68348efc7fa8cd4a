"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: ASCII white space as the query contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session on one machine gets a
    temporary folder, and a cluster an error, as its executors would write to folders that nobody else sees."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses; Hadoop removes it when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_with_hot(rows: DataFrame, side: DataFrame, on: list[str], count: str, hot: int, most: int) -> DataFrame:
    """rows joined with side, which has one row for each value of on and in count how many rows have it.

    Values that hot rows and more share are sent to every task, if there are at most so many of them, so that their rows stay where they are;
    the others are joined by a shuffle. side should be a written table, as it is read several times.
    """
    shared = side.filter(F.col(count) >= hot).drop(count)
    if not 0 < shared.count() <= most:
        return rows.join(side.drop(count), on)
    rest = rows.join(F.broadcast(shared.select(*on)), on, "left_anti").join(side.filter(F.col(count) < hot).drop(count), on)
    return rows.join(F.broadcast(shared), on).unionByName(rest)


def joined_with_hubs(rows: DataFrame, side: DataFrame, on: str, counted: DataFrame, hub: int, most: int) -> DataFrame:
    """rows joined with side, which has one row for each value of on. Values that more than hub rows of counted share are dealt to several
    tasks, and side's row goes to each of them.

    counted: a written table with the column on, whose counts are at least those of rows. At most so many values are dealt, those that most rows share.
    """
    parts = counted.groupBy(on).agg(F.ceil(F.count("*") / hub).cast("int").alias("_parts")).filter("_parts > 1")
    parts = written(parts.orderBy(F.desc("_parts"), on).limit(most), "hubs")
    if parts.isEmpty():
        return rows.join(side, on)
    others = [c for c in rows.columns if c != on]
    part = F.coalesce(F.pmod(F.xxhash64(*others), F.col("_parts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(parts), on, "left").withColumn("_part", part).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copies = side.join(F.broadcast(parts), on, "left").withColumn("_part", every).drop("_parts")
    return dealt.join(copies, [on, "_part"]).drop("_part")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def learnable(doc_id: Column, modulus: int = 3, held_out: int = 1) -> Column:
    """False for rows that only serve to measure: crc32 of the id as text, modulo 3, is 1. True for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus != held_out, F.lit(True))


def learning_sample(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most so many ids of each label, those that hash lowest; rows: doc_id and the label, without texts. Repeated rows count once.

    Labels are counted first (one row a label, which is broadcast) and thinned by the hash, so that only about twice the
    wanted rows of a label meet in a task.
    """
    rows = rows.filter(F.col("doc_id").isNotNull()).distinct()
    counts = rows.groupBy(label).agg(F.count("*").alias("_count"))
    place = F.xxhash64(F.lit("sample"), "doc_id")
    share = (place.cast("double") / float(1 << 63) + 1) / 2
    thinned = rows.join(F.broadcast(counts), label).filter(share <= 2.0 * most / F.col("_count") + 1e-9)
    nth = F.row_number().over(W.partitionBy(label).orderBy(place, "doc_id"))
    return thinned.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth", "_count")


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the position of each row (from 0) in the order of the given columns over all rows.

    Rows are range-partitioned and sorted, so no task sees them all; a row's place within its task and the
    number of the task are written out, and the starts (one row a task) are joined back. Rows that tie in
    every column of order are interchangeable. Nulls sort first.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.select("*", F.shiftright("_at", 33).alias("_task")), "numbered")
    count = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    earlier = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    starts = count.select("_task", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    # one row a task: at most as many as there are shuffle partitions, so the broadcast is bounded
    joined = placed.join(F.broadcast(starts), "_task")
    return joined.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_task", "_start")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, component) for every id in edges(a, b): the smallest id that can be reached over the edges.

    Alternates large-star and small-star steps (Kiveris et al., 2014) on the edge table, each written to the
    shared folder, until nothing changes; each step hangs neighbours on the smallest one, so the graph never gets
    denser and no task holds a whole component.
    """
    # rounds are a guard against a table that changes while it is read: they grow with the logarithm of the longest chain
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node goes to the smallest of the node and its neighbours
        pairs = both(now)
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = pairs.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        now = written(small, "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("b")).first()
        if found == mark and found[0] == found[2]:
            break
        mark = found
    else:
        raise RuntimeError(f"components are unfinished after {rounds} rounds")
    roots = now.select(F.col("a").alias("id")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots.select("id", F.col("id").alias("component")))
