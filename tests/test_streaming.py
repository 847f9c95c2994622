import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from failsift.operators import decode, hooks, index, loglines, search
from failsift.operators.classify import classify, unclassified
from failsift.plans.triage import triage
from failsift.sources import files, store
from failsift.streaming.budget import decide_batch, record_decisions, retry_budget_stream, roots_of
from failsift.streaming.triage import record_batch, triage_stream, unique_events, waiting_events
from tests.test_retry import decisions, frame, random_commands, simulate

START = datetime(2024, 1, 1)


def event(i, status="failed", minute=0, **changes):
    stamp = (START + timedelta(minutes=minute)).strftime("%Y-%m-%d %H:%M:%S UTC")
    return {"build_id": i, "build_status": status, "project_id": 1 + i % 2, "build_finished_at": stamp} | changes


def write_events(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(e) + "\n" for e in events))


def job_blob(i):
    return json.dumps(
        {
            "id": i,
            "name": f"job {i}",
            "web_url": f"https://x/{i}",
            "created_at": "2024-01-01T00:00:00Z",
            "finished_at": "2024-01-01T01:00:00Z",
            "failure_reason": "stuck_or_timeout_failure" if i == 3 else None,
            "status": "failed",
        }
    )


def test_triage_stream_with_redelivery_and_restart(spark, tmp_path):
    root, inbox = str(tmp_path / "store"), tmp_path / "events"
    store.init_store(spark, root)
    blobs = spark.createDataFrame([(job_blob(i),) for i in range(12)], "job_blob STRING")
    jobs = lambda: decode.job_records(blobs)
    projects = lambda: spark.createDataFrame([(1, "a"), (2, "b")], "project_id BIGINT, project_path STRING")
    texts = ["MoveFileEx", "clean", "SIGQUIT: quit", "Error: [S-922]\nMoveFileEx"]
    logs = lambda: spark.createDataFrame([(i, texts[i % 4]) for i in range(12)], "job_id BIGINT, trace STRING")

    first = [event(0), event(1), event(2, "success"), event(3), event(0), event(9, build_finished_at=None)]
    second = [event(0, minute=1), event(4, minute=2), event(6, minute=2), event(3, minute=3)]
    write_events(inbox, "1.json", first)
    write_events(inbox, "2.json", second[:2])

    def run():
        events = decode.job_events(files.payload_stream(spark, str(inbox), files_per_trigger=1))
        writer = triage_stream(events, jobs, projects, logs, root, str(tmp_path / "progress"))
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    write_events(inbox, "3.json", second[2:])
    write_events(inbox, "1-again.json", first)
    run()

    all_events = spark.createDataFrame([(json.dumps(e),) for e in first + second], "payload STRING")
    batch = triage(decode.job_events(all_events), jobs(), projects(), logs())
    stored = store.read_table(spark, root, "ci_failure")
    columns = ["job_id", "type", "job_date", "project_path"]
    assert sorted(stored.select(columns).collect()) == sorted(batch.failures.select(columns).distinct().collect())
    assert stored.count() == stored.select("job_id", "type").distinct().count()
    commands = {r.job_id: r.cmd for r in store.read_table(spark, root, "retry_command").collect()}
    assert commands == {0: "retry", 1: "clear", 2: "clear", 3: "retry", 4: "retry", 6: "retry"}
    assert waiting_events(spark, root, "triage", 99).isEmpty()
    done = [0, 1, 2, 3, 4, 6]
    assert sorted(r.job_id for r in store.read_table(spark, root, "job").collect()) == done
    assert sorted(r.job_id for r in store.read_table(spark, root, "job_log").collect()) == done


def run_to_table(stream, tmp_path, name):
    out = str(tmp_path / name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-progress"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_an_event_is_stored_once_however_late(spark, tmp_path):
    inbox, root = tmp_path / "events", str(tmp_path / "store")
    store.init_store(spark, root)
    write_events(inbox, "1.json", [event(1), event(2), event(1), event(1, "success")])
    write_events(inbox, "2.json", [event(2), event(3, minute=60 * 24 * 90)])
    write_events(inbox, "3.json", [event(2), event(4, minute=5), event(1)])
    events = decode.job_events(files.payload_stream(spark, str(inbox), files_per_trigger=1))
    unique_events(events, root, str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = store.read_table(spark, root, "event").collect()
    assert sorted((r.build_id, r.build_status) for r in got) == [
        (1, "failed"),
        (1, "success"),
        (2, "failed"),
        (3, "failed"),
        (4, "failed"),
    ]


def side_tables(spark, jobs, with_log, projects=((1, "a"), (2, "b")), blob=None):
    blobs = spark.createDataFrame([((blob or job_blob)(i),) for i in jobs], "job_blob STRING")
    return (
        decode.job_records(blobs),
        spark.createDataFrame(list(projects), "project_id BIGINT, project_path STRING"),
        spark.createDataFrame([(i, "MoveFileEx") for i in with_log], "job_id BIGINT, trace STRING"),
    )


def finished_events(spark, events):
    return decode.job_events(spark.createDataFrame([(json.dumps(e),) for e in events], "payload STRING"))


def test_events_far_out_of_order_are_all_handled(spark, tmp_path):
    root = str(tmp_path)
    store.init_store(spark, root)
    tables = side_tables(spark, range(4), range(4))
    for n, hour in enumerate((10, 11, 12, 0)):
        record_batch(finished_events(spark, [event(n, minute=60 * hour)]), *tables, root, "t", n)
    for name in ("job", "job_log", "ci_failure", "retry_command"):
        assert {r.job_id for r in store.read_table(spark, root, name).collect()} == {0, 1, 2, 3}


def test_events_wait_for_record_project_and_log(spark, tmp_path):
    root = str(tmp_path)
    store.init_store(spark, root)
    waits = lambda n: sorted(r.build_id for r in waiting_events(spark, root, "t", n).collect())
    commands = lambda: {r.job_id: r.cmd for r in store.read_table(spark, root, "retry_command").collect()}
    events = finished_events(spark, [event(0), event(1), event(2, project_id=3), event(3, "success"), event(4)])
    none = finished_events(spark, [event(0)]).limit(0)
    unfinished = lambda i: json.dumps(json.loads(job_blob(i)) | ({"finished_at": None} if i == 4 else {}))
    record_batch(events, *side_tables(spark, [0, 2, 3, 4], [2, 3], blob=unfinished), root, "t", 0)
    assert waits(1) == [0, 1, 2] and commands() == {3: "clear", 4: "clear"}
    record_batch(none, *side_tables(spark, [0, 1, 2], [0, 2]), root, "t", 1)
    assert waits(2) == [1, 2] and commands() == {0: "retry", 3: "clear", 4: "clear"}
    for _ in range(2):  # a batch that runs again changes nothing
        record_batch(none, *side_tables(spark, [0, 1, 2], [0, 1, 2], [(1, "a"), (2, "b"), (3, "c")]), root, "t", 2)
        assert waits(3) == [] and commands() == {0: "retry", 1: "retry", 2: "retry", 3: "clear", 4: "clear"}
    assert store.read_table(spark, root, "ci_failure").select("job_id").distinct().count() == 3


def command_rows(spark, rows):
    return spark.createDataFrame(
        [(r, START + timedelta(days=d), q, c, True) for r, d, q, c in rows],
        "root BIGINT, ts TIMESTAMP, seq BIGINT, cmd STRING, accepted BOOLEAN",
    )


def decided(spark, root):
    return {(r.root, r.seq): (r.decision, r.retries_remaining) for r in store.read_table(spark, root, "retry_decision").collect()}


def test_a_count_is_not_forgotten_with_time(spark, tmp_path):
    root = str(tmp_path)
    store.init_store(spark, root)
    record_decisions(command_rows(spark, [(1, 0, i, "retry") for i in range(10)]), root, 0, "b")
    record_decisions(command_rows(spark, [(1, 70, 10, "retry"), (1, -70, 11, "retry")]), root, 1, "b")
    got = decided(spark, root)
    # Within a trigger the earlier time comes first.
    assert got[1, 9] == ("retry", 0) and got[1, 11] == ("exceeded", None) and got[1, 10] == ("retry", 9)


def test_streams_of_other_names_do_not_share_counts_and_a_command_counts_once(spark, tmp_path):
    root = str(tmp_path)
    store.init_store(spark, root)
    record_decisions(command_rows(spark, [(1, 0, i, "retry") for i in range(9)]), root, 0, "a")
    record_decisions(command_rows(spark, [(1, 1, 100 + i, "retry") for i in range(3)]), root, 1, "b")
    assert [decided(spark, root)[1, 100 + i] for i in range(3)] == [("retry", 9), ("retry", 8), ("retry", 7)]
    record_decisions(command_rows(spark, [(1, 0, 3, "retry"), (1, 2, 9, "retry")]), root, 1, "a")
    got = decided(spark, root)
    assert got[1, 9] == ("retry", 0) and got[1, 3] == ("retry", 6)
    assert store.read_table(spark, root, "retry_decision").count() == 13


def test_lineages_from_links_that_come_in_any_order(spark, tmp_path):
    root = str(tmp_path)
    store.init_store(spark, root)
    link = lambda *rows: spark.createDataFrame(list(rows), "job_id BIGINT, new_job_id BIGINT")
    at = lambda *rows: spark.createDataFrame([(j, START, c) for j, c in rows], "job_id BIGINT, ts TIMESTAMP, cmd STRING")
    decide_batch(at((1, "retry"), (3, "retry")), link((1, 2), (3, 4)), root, "t", 0)
    decide_batch(at((2, "retry"), (4, "retry"), (9, "retry")), link((1, 2), (3, 4), (2, 3), (4, 5)), root, "t", 1)
    jobs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 9)], "job_id BIGINT")
    assert {r.job_id: r.root for r in roots_of(spark, root, jobs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}
    got = decided(spark, root)
    assert got[1, 2] == ("retry", 8) and got[1, 4] == ("retry", 7) and got[9, 9] == ("request_failed", None)


def run_to_table(stream, tmp_path, name):
    out = str(tmp_path / name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-progress"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_budget_batches_equal_batch_over_a_restart(spark, tmp_path):
    rows = sorted(random_commands(6, 400, 4, clears=0.03, failures=0.03, hot=0.4), key=lambda r: (r[1], r[2]))
    inbox, root = tmp_path / "commands", str(tmp_path / "store")
    store.init_store(spark, root)
    parts = [rows[:150], rows[150:151], rows[151:300], rows[300:]]

    def put(numbers):
        for n in numbers:
            frame(spark, parts[n]).coalesce(1).write.parquet(str(inbox / f"part={n}"))

    def run():
        schema = frame(spark, []).schema
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(inbox / "part=*"))
        writer = retry_budget_stream(stream, root, str(tmp_path / "progress"))
        writer.trigger(availableNow=True).start().awaitTermination()

    put([0, 1])
    run()
    put([2, 3])
    run()
    stored = store.read_table(spark, root, "retry_decision")
    assert decisions(stored) == simulate(rows)
    written = stored.count()

    # A batch that is run again leaves the same rows.
    again = frame(spark, parts[3])
    number = int(stored.agg(F.max(F.split("batch", "-")[1].cast("int"))).first()[0])
    record_decisions(again, root, number, "budget")
    assert decisions(store.read_table(spark, root, "retry_decision")) == simulate(rows)
    assert store.read_table(spark, root, "retry_decision").count() == written


def test_the_same_operators_run_on_streams(spark, tmp_path):
    inbox = tmp_path / "logs"
    rows = [(1, None, "MoveFileEx\nx"), (2, "runner_system_failure", "fine"), (3, None, "échec total")]
    spark.createDataFrame(rows, "job_id BIGINT, failure_reason STRING, trace STRING").write.parquet(str(inbox))
    batch = spark.read.parquet(str(inbox))
    stream = spark.readStream.schema(batch.schema).parquet(str(inbox))
    steps = {
        "classify": classify,
        "unclassified": unclassified,
        "grep": lambda df: loglines.grep(df, "e"),
        "search": lambda df: search.matches(df, search.phrase("Echec")),
        "terms": index.term_rows,
    }
    for name, step in steps.items():
        want = sorted(map(tuple, step(batch).collect()))
        assert sorted(map(tuple, run_to_table(step(stream), tmp_path, name).collect())) == want and want

    events = tmp_path / "system"
    events.mkdir()
    (events / "1.json").write_text('{"event_name":"project_create","project_id":4}\n{"event_name":"x"}\n')
    created = decode.system_events(files.payload_stream(spark, str(events)))
    plan = run_to_table(hooks.hooks_for_new_projects(created, "https://h"), tmp_path, "plan").collect()
    assert [(r.project_id, r.enable_ssl_verification) for r in plan] == [(4, True)]
