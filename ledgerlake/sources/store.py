"""Folders and tables that driver and executors share, and tables that are written once and read by many jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a session on one machine gets a temporary folder, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Spark's own file sources see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = hadoop_path(spark, path)
    fs.deleteOnExit(at)
    return path


def changed(spark: SparkSession, paths: list[str]) -> tuple:
    """What tells whether the files of the paths are still the same: number, bytes and last change of each."""
    out = []
    for path in paths:
        fs, at = hadoop_path(spark, path)
        files, found = fs.listFiles(at, True), []
        while files.hasNext():
            f = files.next()
            found.append((f.getLen(), f.getModificationTime()))
        out.append((len(found), sum(n for n, _ in found), max((t for _, t in found), default=0)))
    return tuple(out)


#: Names of stored tables by session, what they hold and what it was made from.
_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, key: str, inputs: list[str], make: Callable[[], DataFrame], by: str, buckets: int = 16) -> DataFrame:
    """The rows of make() as a table in buckets of column by, sorted in each, so that joins and aggregations on it need no exchange.

    It is written at the first call of a session and made anew when a file of inputs has changed; it goes when the driver ends.
    """
    at = (spark.sparkContext.applicationId, key, changed(spark, inputs))
    if at not in _STORED or not spark.catalog.tableExists(_STORED[at]):
        name = f"{re.sub(r'[^0-9a-z]+', '_', key.lower())}_{uuid.uuid4().hex[:12]}"
        make().repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", new_folder(spark, name)).saveAsTable(name)
        _STORED[at] = name
    return spark.table(_STORED[at])
