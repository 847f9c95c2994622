"""Raw log files as a data source that opens the chosen files only.

``<id>.log`` and ``<id>/raw`` below a folder are logs. The source lists paths and sizes, takes
filters on ``job_id`` before it plans, and cuts what is left into ranges, so neither an unchosen
file nor its size costs a task anything. Sets of ids too long for a filter come as a table that
the planning reads (``ids``).

A file longer than ``partition_bytes`` comes as several rows, each a range of its bytes. Ranges
end at line ends; a line of more than ``LOOK`` bytes at a cut is cut between two characters. A
task reads many ranges and files, however short they are; the number of tasks follows the bytes
and files in all, and ``cores``.

Columns: ``job_id`` (null where the path names no job), ``path``, ``start`` (first byte), ``size``
(bytes of the row) and ``trace``, null where the bytes are not valid UTF-8.

Planning holds one small record per chosen file, so at most ``MAX_IDS`` ids are taken at once;
:func:`chosen_logs` goes through longer sets in ranges.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from failsift.operators.sizing import JobIds
from failsift.session import settle, work_dir

NAME = "ci_logs"
SCHEMA = "job_id BIGINT, path STRING, start BIGINT, size BIGINT, trace STRING"
# Bytes of a range, and how far a line end is looked for.
PARTITION_BYTES = 64 << 20
LOOK = 1 << 16
# Bytes of a task, what opening a file counts for, and the tasks of a core where that makes them
# smaller. A task costs some 50 ms besides what it reads, so it takes many ranges and files.
TASK_BYTES = 64 << 20
OPEN_BYTES = 1 << 16
TASKS_PER_CORE = 4
# Bytes of log text in one batch of rows.
BATCH_BYTES = 8 << 20
# Ids in a filter, and in a table of ids.
MAX_LISTED_IDS = 1_000
MAX_IDS = 1_000_000

_LOG = re.compile(r"(\d+)(?:\.log|/raw)$")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if re.match(r"file:/(?!//)", path):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Range(InputPartition):
    """Files, or parts of files: (job id, path, first byte, byte after the last, size of the file)."""

    pieces: list[tuple[int | None, str, int, int, int]]


class Chosen:
    """Which ids a scan wants: all bounds and sets hold together."""

    def __init__(self) -> None:
        self.low: int | None = None
        self.high: int | None = None
        self.ids: set[int] | None = None
        self.named = False

    def above(self, low: int) -> None:
        self.low, self.named = low if self.low is None else max(self.low, low), True

    def below(self, high: int) -> None:
        self.high, self.named = high if self.high is None else min(self.high, high), True

    def among(self, ids: set[int]) -> None:
        self.ids, self.named = ids if self.ids is None else self.ids & ids, True

    def take(self, test: Filter) -> bool:
        """Whether a filter is one that is met here."""
        if getattr(test, "attribute", None) != ("job_id",):
            return False
        value = getattr(test, "value", None)
        if isinstance(test, IsNotNull):
            self.named = True
        elif isinstance(test, EqualTo):
            self.among({value})
        elif isinstance(test, In):
            self.among(set(value))
        elif isinstance(test, GreaterThanOrEqual):
            self.above(value)
        elif isinstance(test, GreaterThan):
            self.above(value + 1)
        elif isinstance(test, LessThanOrEqual):
            self.below(value)
        elif isinstance(test, LessThan):
            self.below(value - 1)
        else:
            return False
        return True

    def has(self, job_id: int | None) -> bool:
        if job_id is None:
            return not self.named
        return (
            (self.low is None or self.low <= job_id)
            and (self.high is None or job_id <= self.high)
            and (self.ids is None or job_id in self.ids)
        )


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.look = min(LOOK, self.bytes // 4)
        self.cores = int(options.get("cores", 0))
        self.chosen = Chosen()
        self.table = options.get("ids")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for test in filters:
            if not self.chosen.take(test):
                yield test

    def partitions(self) -> Sequence[InputPartition]:
        if self.table:
            system, path = file_system(self.table)
            rows = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["job_id"])
            self.chosen.among(set(rows.column("job_id").to_pylist()))
        files = self.files()
        task = self.bytes
        if self.cores:
            share = sum(size + OPEN_BYTES for _, _, size in files) // (self.cores * TASKS_PER_CORE)
            task = min(share, max(TASK_BYTES, self.bytes))
        return list(planned(files, self.bytes, task)) or [Range([])]

    def files(self) -> list[tuple[int | None, str, int]]:
        """(job id, path, size) of the chosen files, in the order of their paths."""
        system, root = file_system(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.type != fs.FileType.File or name[0] in "._":
                continue
            match = _LOG.search(info.path)
            job_id = int(match[1]) if match and int(match[1]) < 1 << 63 else None
            if self.chosen.has(job_id):
                found.append((job_id, info.path, info.size))
        return sorted(found, key=lambda f: f[1])

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        rows, held = [], 0
        for path, pieces in groupby(partition.pieces, key=itemgetter(1)):
            with system.open_input_file(path) as file:
                for job_id, _, start, end, size in pieces:
                    first, last = cut(file, start, size, self.look), cut(file, end, size, self.look)
                    if first >= last and size:  # the range before holds these bytes
                        continue
                    data = file.read_at(last - first, first) if last > first else b""
                    rows.append((job_id, path, first, len(data), decoded(data)))
                    held += len(data)
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)


def planned(files: Sequence[tuple[int | None, str, int]], longest: int, task: int) -> Iterator[Range]:
    """Partitions of about ``task`` bytes; files of more than ``longest`` are cut."""
    pieces, held = [], 0
    for job_id, path, size in files:
        for start in range(0, max(size, 1), longest):
            end = min(size, start + longest)
            cost = end - start + (OPEN_BYTES if start == 0 else 0)
            if pieces and held + cost > task:
                yield Range(pieces)
                pieces, held = [], 0
            pieces.append((job_id, path, start, end, size))
            held += cost
    if pieces:
        yield Range(pieces)


def cut(file: pa.NativeFile, at: int, size: int, look: int) -> int:
    """Where a range that should begin at ``at`` begins: after a line end, else between characters."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    window = file.read_at(look + 1, at - 1)
    line = window.find(b"\n")
    if line >= 0:
        return at + line
    inside = next((i for i, b in enumerate(window[1:5]) if b & 0xC0 != 0x80), 0)
    return at + inside


def decoded(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["job_id", "path", "start", "size", "trace"]
    )


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader({k.lower(): v for k, v in self.options.items()})


def raw_logs(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES, ids: str | None = None) -> DataFrame:
    """The log files below a folder; filters on ``job_id`` reach the listing."""
    spark.dataSource.register(LogSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).option("path", folder).option("partitionBytes", partition_bytes)
    reader = reader.option("cores", spark.sparkContext.defaultParallelism)
    return (reader.option("ids", ids) if ids else reader).load()


def chosen_logs(
    spark: SparkSession, folder: str, ids: DataFrame, partition_bytes: int = PARTITION_BYTES, limit: int = MAX_IDS
) -> DataFrame:
    """The logs of the jobs in ``ids``; other files are listed but not opened.

    A short set goes along as a filter, a longer one as a table, and one of more than
    ``limit`` ids in ranges of a table each.
    """
    wanted = JobIds(ids.where("job_id IS NOT NULL"))
    every = lambda table=None: raw_logs(spark, folder, partition_bytes, table)
    if wanted.count <= min(limit, MAX_LISTED_IDS):
        return every().where(F.col("job_id").isin([r.job_id for r in wanted.rows.collect()]))
    parts = -(-wanted.count // limit)
    cuts = wanted.rows.select(F.percentile_approx("job_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({wanted.low - 1, *cuts, wanted.high})
    scans = []
    for low, high in zip(bounds, bounds[1:]):
        table = work_dir(spark, "log-ids")
        wanted.rows.where(F.col("job_id").between(low + 1, high)).write.parquet(table)
        scans.append(every(table))
    return reduce(DataFrame.union, scans)


def write_logs(logs: DataFrame, folder: str) -> DataFrame:
    """Write (job_id, content as bytes) as files; gives job_id, path, size of each.

    A file appears whole or not at all, so a task that runs again leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            done = []
            for job_id, content in zip(batch.column("job_id").to_pylist(), batch.column("content").to_pylist()):
                place = f"{root}/{job_id // 1000}"
                system.create_dir(place, recursive=True)
                draft = f"{place}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(content or b"")
                system.move(draft, f"{place}/{job_id}.log")
                done.append((job_id, f"{place}/{job_id}.log", len(content or b"")))
            columns = list(zip(*done)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())],
                names=["job_id", "path", "size"],
            )

    rows = logs.where("job_id IS NOT NULL").select("job_id", "content")
    return settle(rows.mapInArrow(write, "job_id BIGINT, path STRING, size BIGINT"))
