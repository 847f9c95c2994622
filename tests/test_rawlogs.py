"""The source of raw log files: what is opened, how long files are cut, what filters do."""

import random
from pathlib import Path

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan, StringContains

from failsift.operators import loglines
from failsift.sources import rawlogs
from failsift.sources.rawlogs import LogReader, chosen_logs, raw_logs, write_logs


def put(folder: Path, files: dict[str, bytes]) -> str:
    for name, content in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    return str(folder)


@pytest.fixture
def folder(tmp_path):
    files = {f"{i}.log": f"log {i} é\n".encode() * i for i in range(12)}
    files |= {"a/77/raw": b"nested", "13.log": b"\xff\xfe", "x.log": b"names no job", ".5.log": b"hidden", "notes.txt": b"no log"}
    return put(tmp_path, files)


def ids_of(reader):
    return sorted(p[0] for r in reader.partitions() for p in r.pieces if p[0] is not None)


def test_filters_are_met_before_files_are_opened(folder):
    reader = LogReader({"path": folder})
    tests = [In(("job_id",), (3, 5, 9, 77, 400)), GreaterThanOrEqual(("job_id",), 5), LessThan(("job_id",), 78), IsNotNull(("job_id",))]
    rest = StringContains(("trace",), "x")
    assert list(reader.pushFilters([*tests, rest])) == [rest]
    assert ids_of(reader) == [5, 9, 77]
    one = LogReader({"path": folder})
    assert list(one.pushFilters([EqualTo(("job_id",), 4), EqualTo(("path",), "p")])) == [EqualTo(("path",), "p")]
    assert ids_of(one) == [4]
    assert ids_of(LogReader({"path": folder})) == [*range(12), 13, 77]


def test_unchosen_files_are_never_opened(folder, monkeypatch):
    plain, path = rawlogs.file_system(folder)
    opened = []

    class Watched:
        get_file_info = staticmethod(plain.get_file_info)

        @staticmethod
        def open_input_file(name):
            opened.append(name.rsplit("/", 1)[1])
            return plain.open_input_file(name)

    monkeypatch.setattr(rawlogs, "file_system", lambda _: (Watched, path))
    reader = LogReader({"path": folder})
    list(reader.pushFilters([In(("job_id",), (2, 5, 7)), GreaterThanOrEqual(("job_id",), 3)]))
    got = {row for r in reader.partitions() for b in reader.read(r) for row in b.column("trace").to_pylist()}
    assert got == {f"log {i} é\n" * i for i in (5, 7)} and sorted(opened) == ["5.log", "7.log"]


def test_logs_of_chosen_jobs(spark, folder):
    logs = raw_logs(spark, folder)
    got = logs.where("job_id IN (2, 5) OR job_id = 7").where("job_id > 2")
    assert sorted((r.job_id, r.trace) for r in got.collect()) == [(i, f"log {i} é\n" * i) for i in (5, 7)]
    ids = spark.createDataFrame([(i,) for i in (2, 5, 7, 5, None, 900)], "job_id BIGINT")
    for limit in (rawlogs.MAX_IDS, 2, 1):
        assert sorted(r.job_id for r in chosen_logs(spark, folder, ids, limit=limit).collect()) == [2, 5, 7]
    assert chosen_logs(spark, folder, ids.where("job_id < 0")).count() == 0


def test_rows_of_all_files(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in raw_logs(spark, folder).collect()}
    assert set(rows) == {*(f"{i}.log" for i in range(12)), "13.log", "raw", "x.log", "notes.txt"}
    assert rows["0.log"].trace == "" and rows["0.log"].size == 0
    assert rows["13.log"].trace is None and rows["13.log"].job_id == 13 and rows["13.log"].size == 2
    assert rows["raw"].job_id == 77 and rows["x.log"].job_id is None
    rejected = raw_logs(spark, folder).where("trace IS NULL OR job_id IS NULL").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in rejected) == ["13.log", "notes.txt", "x.log"]
    assert raw_logs(spark, put(Path(folder) / "none", {"y/z.txt": b""})).where("job_id = 1").count() == 0


@pytest.mark.parametrize("size", [16, 40, 100, 4096])
def test_long_files_are_cut_at_lines_or_between_characters(folder, size):
    chance = random.Random(size)
    text = "".join(chance.choice(["short\n", "é" * chance.randrange(60), "日本語\n", "\n", "x" * 30 + "\n"]) for _ in range(300))
    put(Path(folder), {"50.log": text.encode(), "51.log": ("é" * 200).encode(), "52.log": b"\x80" * 100})
    reader = LogReader({"path": folder, "partitionbytes": str(size)})
    list(reader.pushFilters([In(("job_id",), (50, 51, 52))]))
    parts = reader.partitions()
    assert all(sum(p[3] - p[2] for p in r.pieces) <= size for r in parts)
    rows = [dict(zip(b.schema.names, row)) for r in parts for b in reader.read(r) for row in zip(*[c.to_pylist() for c in b.columns])]
    for job_id, whole in ((50, text), (51, "é" * 200)):
        mine = sorted((r for r in rows if r["job_id"] == job_id), key=lambda r: r["start"])
        assert "".join(r["trace"] for r in mine) == whole
        assert [r["start"] for r in mine] == [sum(x["size"] for x in mine[:i]) for i in range(len(mine))]
    assert sum(r["size"] for r in rows if r["job_id"] == 52) == 100 and all(r["trace"] is None for r in rows if r["job_id"] == 52)


def test_a_task_reads_many_short_ranges_and_files(spark, tmp_path):
    chance = random.Random(11)
    folder = put(tmp_path, {f"{i % 7}/{i}.log": b"some line\n" * chance.choice([0, 3, 30, 400]) for i in range(600)} | {"9/900.log": b"\xff" * 3000})
    columns = ["job_id", "path", "start", "size", "trace"]
    one = LogReader({"path": folder, "partitionbytes": "256"})
    want = [row for r in one.partitions() for b in one.read(r) for row in zip(*[b.column(c).to_pylist() for c in columns])]
    assert len(want) > 3000
    parts = raw_logs(spark, folder, partition_bytes=256)
    assert parts.rdd.getNumPartitions() <= 2 * rawlogs.TASKS_PER_CORE * spark.sparkContext.defaultParallelism + 1
    assert sorted(map(tuple, parts.select(columns).collect()), key=str) == sorted(want, key=str)
    # beyond that, a task has TASK_BYTES, also of one long file
    tasks = list(rawlogs.planned([(1, "1.log", 1 << 28), *[(i, f"{i}.log", 100) for i in range(2, 2002)]], 16_384, rawlogs.TASK_BYTES))
    assert len(tasks) == 6 and max(sum(p[3] - p[2] for p in r.pieces) for r in tasks) <= rawlogs.TASK_BYTES
    assert all(p[3] - p[2] <= 16_384 for r in tasks for p in r.pieces) and sum(p[3] - p[2] for r in tasks for p in r.pieces) == (1 << 28) + 200_000


def test_grep_over_ranges_equals_grep_over_logs(spark, tmp_path):
    chance = random.Random(6)
    line = lambda: chance.choice(["ok", "failed: é", "", "error\r", "fine"]) * chance.randrange(1, 4)
    texts = {i: "\n".join(line() for _ in range(chance.randrange(400))) + chance.choice(["", "\n", "\n\n"]) for i in range(15)}
    texts |= {20: "", 21: "ok\n" * 900, 22: "ok\n" * 900 + "error"}
    logs = spark.createDataFrame(list(texts.items()), "job_id BIGINT, trace STRING")
    write_logs(logs.selectExpr("job_id", "CAST(trace AS BINARY) AS content"), f"{tmp_path}/f")
    put(tmp_path / "f", {"0/99.log": b"error\n" * 600 + b"\xff"})
    parts = raw_logs(spark, f"{tmp_path}/f", partition_bytes=512)
    assert parts.groupBy("job_id").count().where("count > 3").count() > 5
    for pattern in ("failed|error", "^$", "e$"):
        want = sorted(map(tuple, loglines.grep(logs, pattern).collect()))
        assert sorted(map(tuple, loglines.grep_ranges(parts, pattern).collect())) == want


def test_written_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"a"), (2500, b""), (7, None), (None, b"x")], "job_id BIGINT, content BINARY")
    done = {r.job_id: (r.path, r.size) for r in write_logs(rows, f"file:{tmp_path}/w").collect()}
    assert {k: v[1] for k, v in done.items()} == {1: 1, 2500: 0, 7: 0}
    assert Path(done[1][0]).read_bytes() == b"a" and done[2500][0].endswith("/2/2500.log")
    assert not [p for p in (tmp_path / "w").rglob(".*") if p.is_file() and not p.name.endswith(".crc")]
