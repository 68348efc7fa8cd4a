"""Filing archives (S4) as a data source of Spark, and facts that are picked out while an archive is read.

Archives are dealt by length: planning packs them greedily, the largest first, each into the lightest partition so far, so that no partition is far above
the mean but for an archive that is. What filters say about doc_id and fetch_day is used in planning, so other archives aren't opened.
Members are parsed as they are decompressed, and elements are freed as they end; of their facts only those of known elements and periods leave a task.
"""

from __future__ import annotations

import datetime
import heapq
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import rules
from ..functions.scalar import DIGITS, FULL_WIDTH, SPACES
from .placing import numbered_by

FORMAT = "filing_archives"
#: Archive members that are read, those of the public document first.
MOST_MEMBERS = 3
FACTS = "doc_id string, fetch_day date, member_idx int, elem_idx int, metric string, bucket string, value double, error string"
#: Rows of a batch that a task gives back.
BATCH = 10_000

NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.A)
WIDE = str.maketrans(FULL_WIDTH, DIGITS, ",")


def elements(stream: IO[bytes]) -> Iterator[tuple[int, str, str, str | None]]:
    """Place in document order, name, context and text of each element with a context, as elements end; what has ended is freed."""
    open_: list[tuple[int, ElementTree.Element]] = []
    place = -1
    for event, e in ElementTree.iterparse(stream, events=("start", "end")):
        if event == "start":
            place += 1
            open_.append((place, e))
            continue
        at, _ = open_.pop()
        if ref := e.attrib.get("contextRef"):
            yield at, e.tag, ref, e.text
        if open_:
            open_[-1][1].remove(e)


def members(archive: zipfile.ZipFile) -> list[str]:
    """The first XBRL members, those of the public document if there are any."""
    names = [n for n in archive.namelist() if n.endswith(".xbrl")]
    return ([n for n in names if "PublicDoc" in n] or names)[:MOST_MEMBERS]


def number(text: str | None) -> float | None:
    """P1, as functions.scalar.parse_number."""
    plain = re.sub(r"(?<=\d)_(?=\d)", "", (text or "").strip(SPACES).translate(WIDE), flags=re.A)
    value = float(plain) if NUMBER.fullmatch(plain) else None
    return value if value is not None and abs(value) < float("inf") else None


def bucket(ref: str, prior: str = "prioryear") -> str | None:
    """P3, as functions.scalar.context_bucket."""
    low = ref.lower()
    when = "previous" if re.search(prior, low) else "current" if "current" in low else None
    span = "duration" if "duration" in low else "instant" if "instant" in low else None
    return f"{when}_{span}" if when and span else None


def wanted_facts(read: Callable[[], IO[bytes]], prior: str = "prioryear") -> tuple[list[tuple], str | None]:
    """(member, place, metric, bucket, value) of the known elements of an archive, and no error; or no fact, and what is wrong with it."""
    metric_of = {t: m for m, tags in rules.METRIC_TAGS.items() for t in tags}
    rows = []
    try:
        with read() as f, zipfile.ZipFile(f) as z:
            for m, name in enumerate(members(z)):
                with z.open(name) as stream:
                    for place, tag, ref, text in elements(stream):
                        metric = metric_of.get(tag.rpartition("}")[2])
                        if metric and (period := bucket(ref, prior)) and (value := number(text)) is not None:
                            rows.append((m, place, metric, period, value))
    except Exception as bad:  # whatever is wrong with one archive must not end the job
        return [], f"{type(bad).__name__}: {bad}"
    return rows, None


def opened(path: str) -> IO[bytes]:
    """A file for reading at any place, inside a task: local paths, object stores and hdfs."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    fs, at = (LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else FileSystem.from_uri(path)
    return fs.open_input_file(at)


def packed(sizes: list[int], bins: int) -> list[list[int]]:
    """Indices dealt to bins of about equal sums: the largest first, each to the bin that is lightest; empty bins fall away."""
    heap = [(0, b) for b in range(bins)]
    out: list[list[int]] = [[] for _ in range(bins)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, b = heapq.heappop(heap)
        out[b].append(i)
        heapq.heappush(heap, (load + sizes[i] + 1, b))  # so that empty files count as well
    return [b for b in out if b]


def listed(path: str, first: datetime.date | None, last: datetime.date | None) -> list[tuple[str, str, datetime.date | None, int]]:
    """doc_id, path, day and length of the archives in a folder. Below folders fetch_day=... only those of days in the range are listed."""
    from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem

    local = path.startswith(("file:", "/"))
    fs, at = (LocalFileSystem(), re.sub("^file:/*", "/", path)) if local else FileSystem.from_uri(path)
    prefix = "" if local else path[: len(path) - len(at)] if path.endswith(at) else f"{path.partition('://')[0]}://"
    out = []

    def walk(folder: str, day: datetime.date | None) -> None:
        for f in fs.get_file_info(FileSelector(folder)):
            if f.type == FileType.Directory:
                m = re.fullmatch(r"fetch_day=(\d{4}-\d{2}-\d{2})", f.base_name)
                below = datetime.date.fromisoformat(m[1]) if m else day
                if not m or (first is None or below >= first) and (last is None or below <= last):
                    walk(f.path, below)
            elif f.base_name.endswith(".zip") and (first is None and last is None or day is not None):
                out.append((f.base_name[:-4], prefix + f.path, day, f.size))

    walk(at.rstrip("/"), None)
    return out


class Archives(InputPartition):
    """The archives of one partition: (doc_id, path, day), and their bytes."""

    def __init__(self, files: list[tuple[str, str, datetime.date | None]], size: int):
        super().__init__((files, size))


class ArchivesReader(DataSourceReader):
    def __init__(self, path: str, partitions: int, prior: str):
        self.path, self.count, self.prior = path, partitions, prior
        self.ids: set[str] | None = None
        self.first: datetime.date | None = None
        self.last: datetime.date | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        day = datetime.timedelta(days=1)
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                ids = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = ids if self.ids is None else self.ids & ids
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("fetch_day",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(x for x in (self.first, f.value + day * isinstance(f, GreaterThan)) if x)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(x for x in (self.last, f.value - day * isinstance(f, LessThan)) if x)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = [f for f in listed(self.path, self.first, self.last) if self.ids is None or f[0] in self.ids]
        return [Archives([files[i][:3] for i in part], sum(files[i][3] for i in part)) for part in packed([f[3] for f in files], self.count)] or [Archives([], 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for doc_id, path, day in partition.value[0]:
            rows, error = wanted_facts(lambda: opened(path), self.prior)
            if error:
                yield doc_id, day, None, None, None, None, None, error
            for row in rows:
                yield doc_id, day, *row, None


class FilingArchives(DataSource):
    """spark.read.format("filing_archives").load(folder): facts of the archives in a folder, which may have folders fetch_day=... below it.

    Options: partitions (8), and prior, the pattern of contexts of the year before. An archive that can't be read gives one row with its error.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FACTS

    def reader(self, schema) -> DataSourceReader:
        return ArchivesReader(self.options["path"], int(self.options.get("partitions", "8")), self.options.get("prior", "prioryear"))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed into planning."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingArchives)


def archive_facts(spark: SparkSession, path: str, tasks: int | None = None, prior: str = "prioryear") -> DataFrame:
    """S4 with P1 to P4: the facts of a folder of archives, to be filtered by doc_id and fetch_day before anything else."""
    register(spark)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.format(FORMAT).option("partitions", str(tasks)).option("prior", prior).load(path)


def dealt(files: DataFrame, tasks: int) -> DataFrame:
    """doc_id, path and length of archives with the task of each: rows are numbered by length and dealt to and fro, so that each task gets one of
    every so many consecutive ones, and none gets more than the mean and the largest archive together."""
    n = F.col("_place") % (2 * tasks)
    task = F.when(n < tasks, n).otherwise(2 * tasks - 1 - n).cast("int")
    return numbered_by(files.select("doc_id", "path", "length"), ["length", "doc_id"], "_place").withColumn("_task", task).drop("_place")


def facts_of(files: DataFrame, tasks: int, prior: str = "prioryear") -> DataFrame:
    """The same for archives that are rows, so that any number of wanted documents can be joined: files holds doc_id, path and length."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        out: list[tuple] = []
        frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"member_idx": "Int32", "elem_idx": "Int32", "value": "float64"})
        for b in batches:
            for doc_id, path in zip(b["doc_id"], b["path"], strict=True):
                rows, error = wanted_facts(lambda: opened(path), prior)
                out += [(doc_id, None, None, None, None, None, None, error)] if error else [(doc_id, None, *r, None) for r in rows]
                if len(out) >= BATCH:
                    yield frame(out)
                    out = []
        if out:
            yield frame(out)

    return dealt(files, tasks).repartitionById(tasks, "_task").select("doc_id", "path").mapInPandas(parse, FACTS).withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
