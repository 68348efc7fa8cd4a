"""A snapshot of records that is kept up to date: buckets by a hash of the code, and manifests that say which files make up a state.

An update writes the buckets that it touches as new files, and then a manifest, which alone makes them part of the snapshot. A run that fails before
that leaves the state as it was. Files of a state are never changed, so readers of an older one aren't disturbed until vacuum takes its files.
One writer at a time; of two, the second one to commit fails, as the manifest's number is taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .snapshots import RECORD
from .store import hadoop_path

BUCKETS = 64
SCHEMA = f"code string, record {RECORD}"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("code"), F.lit(buckets)).cast("int")


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, at = hadoop_path(spark, f"{path}/manifest")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The newest state, or that of a number: number, buckets, folders by bucket, and what else its writer put down. None if there is none."""
    found = _numbers(spark, path)
    if not found:
        return None
    text = spark.read.text(f"{path}/manifest/{found[-1] if number is None else number:08d}.json", wholetext=True).first().value
    return json.loads(text)


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Writes a manifest under a name of its own and renames it, so that a state is there whole or not at all."""
    fs, final = hadoop_path(spark, f"{path}/manifest/{state['number']:08d}.json")
    _, draft = hadoop_path(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(state, ensure_ascii=False).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"state {state['number']} of {path} was committed by another writer")


def _write(rows: DataFrame, path: str, buckets: int, tasks: int) -> str:
    """Rows in a folder for each bucket; returns where these are, below path."""
    version = f"data/{uuid.uuid4().hex}"
    dealt = rows.select("code", "record", _bucket(buckets).alias("bucket")).repartition(tasks, "bucket").sortWithinPartitions("bucket", "code")
    dealt.write.partitionBy("bucket").parquet(f"{path}/{version}")
    return version


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(code, record) of the newest state, or of that of a number."""
    state = manifest(spark, path, number)
    folders = [f"{path}/{f}" for f in state["folders"].values()] if state else []
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def create(records: DataFrame, path: str, buckets: int = BUCKETS, **notes) -> dict:
    """The first state of a snapshot: records (code, record), one of each code."""
    return _next(records.sparkSession, path, {"number": -1, "buckets": buckets, "folders": {}}, records, list(range(buckets)), notes)


def upsert(new: DataFrame, path: str, **notes) -> dict:
    """A state in which new (code, record) replaces records of the same codes. Only buckets that new has codes of are read and written."""
    spark = new.sparkSession
    state = manifest(spark, path) or {"number": -1, "buckets": BUCKETS, "folders": {}}
    touched = sorted(r.b for r in new.select(_bucket(state["buckets"]).alias("b")).distinct().collect())  # as many as there are buckets at most
    held = [f"{path}/{state['folders'][str(b)]}" for b in touched if str(b) in state["folders"]]
    if held:
        old = spark.read.schema(SCHEMA).parquet(*held)
        new = old.join(new.select("code"), "code", "left_anti").unionByName(new.select("code", "record"))
    return _next(spark, path, state, new, touched, notes)


def _next(spark: SparkSession, path: str, state: dict, rows: DataFrame, touched: list[int], notes: dict) -> dict:
    folders = {b: f for b, f in state["folders"].items() if int(b) not in touched}
    if touched:
        version = _write(rows, path, state["buckets"], max(1, min(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions")))))
        fs, at = hadoop_path(spark, f"{path}/{version}")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        folders |= {n.partition("=")[2]: f"{version}/{n}" for n in names if n.startswith("bucket=")}
    after = state | notes | {"number": state["number"] + 1, "folders": folders}
    _commit(spark, path, after)
    return after


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all but the newest states, and the files that only those held; returns how many folders went."""
    numbers = _numbers(spark, path)
    held = {f for n in numbers[-keep:] for f in manifest(spark, path, n)["folders"].values()}
    fs, at = hadoop_path(spark, f"{path}/data")
    for n in numbers[:-keep]:
        fs.delete(hadoop_path(spark, f"{path}/manifest/{n:08d}.json")[1], False)
    gone = 0
    for version in fs.listStatus(at) if fs.exists(at) else []:
        name = version.getPath().getName()
        inner = [f.getPath() for f in fs.listStatus(version.getPath()) if f.getPath().getName().startswith("bucket=")]
        spare = [p for p in inner if f"data/{name}/{p.getName()}" not in held]
        for p in spare:
            fs.delete(p, True)
        gone += len(spare)
        if len(spare) == len(inner):
            fs.delete(version.getPath(), True)
    return gone
