from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from failsift.operators import backfill, enrich, hooks, index, loglines, search, upsert
from failsift.operators.sizing import JobIds
from failsift.plans import archive
from failsift.plans.triage import hits_of, triage
from failsift.sources import files, store


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_new_rows(spark):
    old = spark.createDataFrame([(1, "a", "x")], "job_id BIGINT, type STRING, note STRING")
    new = spark.createDataFrame(
        [(1, "a", "y"), (1, "b", "p"), (1, "b", "o"), (2, "a", "z"), (2, "a", "z")],
        "job_id BIGINT, type STRING, note STRING",
    )
    assert rows_of(upsert.new_rows(new, old, ["job_id", "type"])) == [(1, "b", "o"), (2, "a", "z")]
    assert rows_of(upsert.missing(new.select("job_id").distinct(), old)) == [(2,)]


def test_copies_merge_before_the_shuffle(spark):
    copies = spark.range(1000).selectExpr("1 AS job_id", "'a' AS type", "CAST(id % 3 AS STRING) AS note")
    merged = upsert.one_per_key(copies, ["job_id", "type"])
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange hashpartitioning")
    assert rows_of(merged) == [(1, "a", "0")]


def test_job_ids_pick_or_refuse(spark):
    wide = spark.createDataFrame([(i, "t" * i) for i in range(10)], "job_id BIGINT, trace STRING")
    ids = JobIds(spark.createDataFrame([(3,), (3,), (5,), (77,)], "job_id BIGINT"))
    assert rows_of(ids.pick(wide)) == [(3, "ttt"), (5, "ttttt")]
    assert ids.pick(wide, limit=2) is None
    assert JobIds(wide.where("job_id > 99")).pick(wide).count() == 0


def jobs_frame(spark, n):
    blobs = [
        f'{{"id":{i},"name":"n","web_url":"https://x/{i}","status":"failed","created_at":"2024-01-{1 + i % 28:02d}T00:00:00Z"}}'
        for i in range(n)
    ]
    rows = [(b,) for b in blobs]
    return spark.createDataFrame(rows, "job_blob STRING")


def test_store_is_idempotent(spark, tmp_path):
    root = str(tmp_path / "store")
    store.init_store(spark, root)
    store.init_store(spark, root)
    schema = "job_id BIGINT, job_url STRING, created_at TIMESTAMP, job_blob STRING"
    first = spark.createDataFrame([(1, "u", None, "{}"), (1, "u", None, "{}"), (2, "u", None, "{}")], schema)
    second = spark.createDataFrame([(2, "other", None, "{}"), (3, "u", None, "{}")], schema)
    assert store.append_new(first, root, "job", "b1") == 2
    assert store.append_new(second, root, "job", "b2") == 1
    assert store.append_new(second, root, "job", "b2") == 1
    assert store.append_new(first, root, "job", "b1") == 2
    assert store.append_new(first.limit(0), root, "job", "b3") == 0
    got = rows_of(store.read_table(spark, root, "job").select("job_id", "job_url"))
    assert got == [(1, "u"), (2, "u"), (3, "u")]


def test_a_hot_term_is_spread_over_files_that_hold_ranges(spark, tmp_path):
    root = str(tmp_path)
    store.init_store(spark, root)
    texts = [(i, "hot " * 30 + " ".join(f"w{(i * 7 + j) % 300:03d}" for j in range(30))) for i in range(200)]
    logs = spark.createDataFrame(texts, "job_id BIGINT, trace STRING")
    terms = index.term_rows(logs)
    store.write_index(terms, root, "all", 12)
    stored = store.read_index(spark, root)
    assert sorted(stored.select("term", "job_id", "pos").collect()) == sorted(terms.collect())
    files = stored.groupBy("_metadata.file_path").agg(F.min("term"), F.max("term"), F.count_if(F.col("term") == "hot"))
    bounds = sorted(tuple(r)[1:] for r in files.collect())
    assert sum(hot > 0 for _, _, hot in bounds) >= 4
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:]))
    prefix = index.jobs_with_prefix(stored, "w00")
    assert sorted(r.job_id for r in prefix.collect()) == sorted(i for i, t in texts if " w00" in t)


def test_logs_are_stored_and_indexed_once(spark, tmp_path):
    root = str(tmp_path / "store")
    store.init_store(spark, root)
    schema = "job_id BIGINT, trace STRING"
    first = spark.createDataFrame([(1, "Alpha beta"), (2, "beta gamma")], schema)
    second = spark.createDataFrame([(2, "changed"), (3, "alpha gamma")], schema)
    assert store.append_logs(first, first, root, "b1") == 2
    assert store.append_logs(second, second, root, "b2") == 1
    assert store.append_logs(second, second, root, "b2") == 1
    got = rows_of(store.read_table(spark, root, "job_log").select("job_id", "norm"))
    assert got == [(1, " alpha beta "), (2, " beta gamma "), (3, " alpha gamma ")]
    terms = store.read_index(spark, root, "alpha", "gamma")
    assert rows_of(index.jobs_with_all(terms, "alpha", "gamma")) == [(3,)]
    assert rows_of(index.jobs_with_any(store.read_index(spark, root), "beta")) == [(1,), (2,)]
    plan = index.jobs_with_any(store.read_index(spark, root, "beta"), "beta")._jdf.queryExecution().toString()
    assert "EqualTo(term,beta)" in plan
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,beta)" in plan


def test_archive_backfill(spark, tmp_path):
    root = str(tmp_path / "store")
    store.init_store(spark, root)
    pages = tmp_path / "listing"
    jobs_frame(spark, 40).repartition(4).write.text(str(pages))
    listing = files.job_listing(spark, str(pages)).withColumn("project_id", F.lit(1))
    start, end = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (3, 5))
    assert archive.stage_jobs(listing, root, start, end, "stage") == 6
    waiting = rows_of(archive.backlog(spark, root))
    assert [r[0] for r in waiting] == [2, 3, 4, 30, 31, 32]
    logs = spark.createDataFrame([(i, f"log {i}") for i in range(31)], "job_id BIGINT, trace STRING")
    assert archive.drain_backlog(logs, root, "drain-1") == 4
    assert [r[0] for r in rows_of(archive.backlog(spark, root))] == [31, 32]
    assert archive.drain_backlog(logs, root, "drain-2") == 0
    assert store.read_table(spark, root, "log_term").count() == 8


def test_page_age_and_range(spark):
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    rows = [(0, 20), (0, 19), (1, 12), (1, 9), (2, 3), (2, 2), (3, 5), (3, 10)]
    jobs = spark.createDataFrame(
        [(p, day(d), "failed", 1) for p, d in rows] + [(4, day(6), "running", 1), (4, day(6), "failed", 2)],
        "page INT, created_at TIMESTAMP, status STRING, project_id INT",
    )
    got = {r.page: r.age for r in backfill.page_age(jobs, day(5), day(10)).collect()}
    assert got == {0: "too_young", 1: "found", 2: "too_old", 3: "found", 4: "found"}
    assert sorted(r.created_at.day for r in backfill.in_range(jobs, day(5), day(10)).collect()) == [5, 9, 10]


def test_readers(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "12.log").write_bytes("ok é\n".encode())
    (logs / "13.log").write_bytes(b"bad \xff\n")
    (logs / "notes.txt").write_bytes(b"x")
    (logs / "14").mkdir()
    (logs / "14" / "raw").write_bytes(b"raw")
    paths = [str(logs), str(logs / "14")]
    assert rows_of(files.logs(spark, paths)) == [(12, "ok é\n"), (14, "raw")]
    assert {r.job_id for r in files.rejected_logs(spark, paths).collect()} == {13, None}

    (tmp_path / "hooks.json").write_text('{"id":1,"url":"http://h:8080/x","project_id":5}\n')
    (tmp_path / "projects.json").write_text(
        '{"id":5,"path_with_namespace":"a/b"}\n{"id":6,"path_with_namespace":"a/c"}\n'
    )
    projects = files.project_listing(spark, str(tmp_path / "projects.json"))
    hook_rows = files.hook_listing(spark, str(tmp_path / "hooks.json"))
    assert rows_of(hooks.without_hook(projects, hook_rows)) == [(6, "a/c")]
    assert rows_of(hooks.with_hook(projects, hook_rows)) == [(5, "a/b")]
    assert [r.project_id for r in hooks.newest_first(projects).collect()] == [6, 5]

    (tmp_path / "event.json").write_text('{\n "build_id": 1\n}')
    whole = files.payloads(spark, str(tmp_path / "event.json"), whole_files=True)
    assert whole.count() == 1 and whole.columns == ["payload"]
    binary = spark.createDataFrame([(bytearray(b'{"a":1}'),)], "value BINARY")
    assert files.payload_of(binary).first().payload == '{"a":1}'


def test_hook_plans(spark):
    events = spark.createDataFrame([("project_create", 1), ("other_project", 2)], "kind STRING, project_id BIGINT")
    secure = hooks.hooks_for_new_projects(events, "https://h/x").collect()
    assert [tuple(r) for r in secure] == [(1, "https://h/x", True, False, True)]
    plain = hooks.hooks_for_new_projects(events, "http://h/x").first()
    assert plain.enable_ssl_verification is False
    projects = spark.createDataFrame([(1,), (2,)], "project_id BIGINT")
    present = spark.createDataFrame([(1, "http://a:8080/"), (2, "http://a:80/")], "project_id BIGINT, url STRING")
    audit = hooks.hooks_from_audit(projects, present, "https://h/x").collect()
    assert [tuple(r) for r in audit] == [(2, "https://h/x", True, False, False)]


def test_grep(spark):
    logs = spark.createDataFrame(
        [(9, "an error\nok\nError\n"), (10, "fine\n"), (100, ""), (11, "a\r error b"), (12, "error")],
        "job_id BIGINT, trace STRING",
    )
    ids = spark.createDataFrame([(9,), (10,), (100,), (11,), (77,)], "job_id BIGINT")
    got = [(r.job_id, r.line_no, r.line) for r in loglines.grep_jobs(logs, ids, "^.*[Ee]rror").collect()]
    assert got == [
        (9, 1, "9:an error"),
        (9, 3, "9:Error"),
        (11, 1, "11:a\r error b"),
        (100, 0, "100:"),
        (10, 0, "10:"),
    ]
    assert loglines.grep(logs.where("job_id = 9"), "^$").first().line_no == 0


def test_grep_with_a_long_selection(spark, monkeypatch):
    logs = spark.createDataFrame([(i, f"x\nhit {i}") for i in range(20)], "job_id BIGINT, trace STRING")
    ids = logs.where("job_id % 2 = 0").select("job_id")
    short = rows_of(loglines.grep_jobs(logs, ids, "hit"))
    monkeypatch.setattr(JobIds, "pick", lambda self, wide: None)
    assert rows_of(loglines.grep_jobs(logs, ids, "hit")) == short and len(short) == 10


def test_failing_tests_and_kinds(spark):
    logs = spark.createDataFrame(
        [
            (1, 'x\nTEST="T700 some_plugin odd_holes"\nTEST="T1"'),
            (2, ' TEST="T9"\nTEST="T1  T2" etc\n\rTEST="T8"'),
            (3, 'TEST="a\nb"'),
        ],
        "job_id BIGINT, trace STRING",
    )
    tests = loglines.failing_tests(logs)
    assert rows_of(tests) == [("T1",), ("T2",), ("T700",), ("odd_holes",), ("some_plugin",)]
    defs = spark.createDataFrame(
        [("T1", "collect_stats"), ("T1", "collect_stats"), ("T2", "collect_compiler_stats"), ("T2", "normal"),
         ("T7", "collect_stats")],
        "test_name STRING, kind STRING",
    )
    assert rows_of(loglines.stat_test_kinds(tests, defs)) == [("collect_compiler", 1), ("collect_stats", 2)]
    assert rows_of(loglines.stat_test_kinds(tests.limit(0), defs)) == [("collect_compiler", 0), ("collect_stats", 0)]


def test_stat_tests_in_source_lines(spark):
    text = ["test('T1',", " [a,", "  collect_stats,", "x", "  collect_compiler_x]", "T1 T2 collect_stats", "", "", "collect_stats", "collect_stats"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)] + [(2, 0, "collect_stats T3")], "file INT, line_no INT, text STRING")
    tests = spark.createDataFrame([("T1",), ("T2",), ("T2",)], "test_name STRING")
    # T1: lines 2, 5, 8; T2: lines 5, 8.
    assert rows_of(loglines.stat_tests_from_source(lines, tests)) == [("collect_compiler", 0), ("collect_stats", 5)]


def test_long_id_sets_move_no_wide_row(spark):
    wide = spark.range(3000).selectExpr("id AS job_id", "repeat('x', 20) AS trace")
    ids = JobIds(spark.range(0, 3000, 3).selectExpr("id AS job_id"))
    got = ids.select_from(wide, limit=100)
    assert sorted(r.job_id for r in got.collect()) == list(range(0, 3000, 3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_windows_failures(spark):
    ts = lambda d: datetime(2025, 4, d)
    builds = spark.createDataFrame(
        [
            (1, "my-windows-box", 1, ts(12), "failed"),
            (2, "windows", 1, ts(14), "failed"),
            (3, "windows", 1, ts(9), "failed"),
            (4, "windows", 1, None, "failed"),
            (5, "windows", 2, ts(14), "failed"),
            (6, "windows", 1, ts(14), "success"),
            (7, "linux", 1, ts(14), "failed"),
        ],
        "id BIGINT, name STRING, project_id BIGINT, started_at TIMESTAMP, status STRING",
    )
    assert [r.id for r in loglines.windows_failures(builds, "2025-04-09").collect()] == [2, 1]


def test_imported_failures(spark):
    view = spark.createDataFrame(
        [(1, "docker", datetime(2024, 1, 1), "u", None)],
        "job_id BIGINT, typ STRING, created_at TIMESTAMP, web_url STRING, runner_id INT",
    )
    got = enrich.imported_failures(view).first()
    assert (got.type, got.job_date, got.runner_id, got.job_name) == ("docker", datetime(2024, 1, 1), None, None)


@pytest.fixture
def flow(spark):
    events = spark.createDataFrame(
        [(1, "failed", 5, datetime(2024, 1, 1)), (2, "failed", 5, datetime(2024, 1, 1)), (3, "success", 5, datetime(2024, 1, 1)),
         (4, "failed", 5, None), (5, "failed", 6, datetime(2024, 1, 1)), (6, "failed", 5, datetime(2024, 1, 1))],
        "build_id BIGINT, build_status STRING, project_id BIGINT, build_finished_at TIMESTAMP",
    )
    day = datetime(2024, 1, 2)
    jobs = spark.createDataFrame(
        [(i, f"u{i}", None, None, day, None if i == 6 else day, "runner_system_failure" if i == 2 else None, f"j{i}", "{}")
         for i in range(1, 7)],
        "job_id BIGINT, web_url STRING, runner_id BIGINT, runner_name STRING, created_at TIMESTAMP, "
        "finished_at TIMESTAMP, failure_reason STRING, job_name STRING, job_blob STRING",
    )
    projects = spark.createDataFrame([(5, "grp/five")], "project_id BIGINT, project_path STRING")
    logs = spark.createDataFrame([(i, "MoveFileEx") for i in range(1, 7)], "job_id BIGINT, trace STRING")
    return events, jobs, projects, logs


def test_triage(spark, flow):
    result = triage(*flow)
    assert rows_of(result.jobs.select("job_id")) == [(1,), (2,), (3,)]
    assert rows_of(result.failures.select("job_id", "type", "project_path")) == [
        (1, "MoveFileEx", "grp/five"),
        (2, "MoveFileEx", "grp/five"),
        (2, "runner_system", "grp/five"),
    ]
    assert {r.job_date for r in result.failures.collect()} == {datetime(2024, 1, 2)}
    assert rows_of(result.commands.select("job_id", "cmd")) == [(1, "retry"), (2, "retry"), (3, "clear")]


def test_hits_do_not_depend_on_the_way(spark, flow, monkeypatch):
    _, jobs, _, logs = flow
    failed = jobs.where("job_id < 4")
    picked = rows_of(hits_of(failed, logs))
    monkeypatch.setattr(JobIds, "pick", lambda self, wide: None)
    assert rows_of(hits_of(failed, logs)) == picked and len(picked) == 4


def test_no_join_moves_a_log(spark, flow, tmp_path):
    events, jobs, projects, logs = flow
    path = str(tmp_path / "logs")
    search.with_norm(logs).write.parquet(path)
    stored = spark.read.parquet(path)
    plan = hits_of(jobs, stored)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert all("trace" not in line for line in exchanges)
    assert "trace" not in triage(events, jobs, projects, stored).failures._jdf.queryExecution().toString()
    assert "ReadSchema: struct<job_id:bigint,trace:string>" in plan


def test_stored_norm_is_read_alone(spark, flow, tmp_path):
    path = str(tmp_path / "logs")
    search.with_norm(flow[3]).write.parquet(path)
    found = search.matches(spark.read.parquet(path), search.any_of(search.phrase("a"), search.phrase("movefileex")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<job_id:bigint,norm:string>" in plan and "Exchange" not in plan
    assert found.count() == 6
