import json
from datetime import datetime

from pyspark.sql import functions as F

from failsift.functions.fields import canonical_json
from failsift.operators import decode

EVENT = {
    "object_kind": "build",
    "build_id": 101,
    "build_status": "failed",
    "build_finished_at": "2025-03-09 04:05:06 UTC",
    "project_id": 1,
    "runner": {"id": 31},
}
JOB = {
    "id": 7,
    "status": "failed",
    "name": "build-and-check",
    "created_at": "2025-03-08T22:10:20.125Z",
    "finished_at": "2025-03-09T05:00:30.750+01:00",
    "failure_reason": "some_other_reason",
    "web_url": "https://ci.example.org/a/b/-/jobs/7",
    "runner": {"id": 12, "description": "box-12", "active": True},
    "pipeline": {"source": "push"},
}


def payloads(spark, *items, name="payload"):
    texts = [(i, t if isinstance(t, str) else json.dumps(t)) for i, t in enumerate(items)]
    return spark.createDataFrame(texts, f"n INT, {name} STRING")


def without(d, *keys):
    return {k: v for k, v in d.items() if k not in keys}


def test_job_events(spark):
    raw = payloads(
        spark,
        EVENT,
        EVENT | {"build_finished_at": None, "build_status": "running"},
        without(EVENT, "build_finished_at"),
        without(EVENT, "build_id") | {"buld_id": 101},
        EVENT | {"build_id": "101"},
        EVENT | {"build_status": 5},
        EVENT | {"build_finished_at": "yesterday"},
        EVENT | {"project_id": None},
        '{"build_id": 1, ',
        "[]",
    )
    good = {r.n: r for r in decode.job_events(raw).collect()}
    assert set(good) == {0, 1}
    assert good[0].build_id == 101 and good[0].project_id == 1
    assert good[0].build_finished_at == datetime(2025, 3, 9, 4, 5, 6)
    assert good[1].build_finished_at is None
    assert {r.n for r in decode.rejected_events(raw).collect()} == set(range(2, 10))
    assert [r.n for r in decode.finished(decode.job_events(raw)).collect()] == [0]


def test_dispatch(spark):
    raw = payloads(spark, EVENT, EVENT | {"build_status": "success"}, EVENT | {"build_finished_at": None})
    got = {r.n: (r.status_kind, r.to_index, r.to_classify) for r in decode.dispatch(decode.job_events(raw)).collect()}
    assert got == {0: ("failed", True, True), 1: ("other", True, False)}


def test_system_events(spark):
    raw = payloads(
        spark,
        {"event_name": "project_create", "project_id": 15, "owners": [{"name": "K"}]},
        {"event_name": "project_destroy", "project_id": 16},
        {"event_name": "user_destroy", "user_id": 17},
        {"project_id": 5},
        {"event_name": 3, "project_id": 5},
        "not json",
    )
    got = {r.n: (r.kind, r.project_id) for r in decode.system_events(raw).collect()}
    assert got[0] == ("project_create", 15)
    assert got[1] == ("other_project", 16)
    assert all(got[n] == ("other", None) for n in (2, 3, 4, 5))


def test_job_records(spark):
    raw = payloads(
        spark,
        JOB,
        JOB | {"id": 8, "runner": None, "finished_at": None, "failure_reason": None},
        without(JOB, "runner", "finished_at", "failure_reason") | {"id": 9},
        JOB | {"id": 10, "runner": {"id": 1}},
        JOB | {"id": 11, "runner": {"id": 1, "description": None}},
        without(JOB, "web_url"),
        JOB | {"web_url": "http://a b"},
        JOB | {"created_at": "soon"},
        without(JOB, "name"),
        JOB | {"runner": "gone"},
        name="job_blob",
    )
    got = {r.job_id: r for r in decode.job_records(raw).collect()}
    assert set(got) == {7, 8, 9, 11}
    first = got[7]
    assert (first.runner_id, first.runner_name) == (12, "box-12")
    assert first.created_at == datetime(2025, 3, 8, 22, 10, 20, 125000)
    assert first.finished_at == datetime(2025, 3, 9, 4, 0, 30, 750000)
    assert first.failure_reason == "some_other_reason"
    assert first.job_blob == json.dumps(JOB, sort_keys=True, separators=(",", ":"))
    assert got[8].runner_id is None and got[9].runner_name is None and got[8].finished_at is None
    assert got[11].runner_id == 1 and got[11].runner_name is None
    assert {r.n for r in decode.rejected_jobs(raw).collect()} == {3, 5, 6, 7, 8, 9}


def test_canonical_json(spark):
    text = '{ "b": 1.5, "a": {"y": null, "x": "a\\u0026\\n"}, "c": [2, 1] }'
    df = spark.createDataFrame([(text,), ("{",)], "t STRING").select(canonical_json(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == ['{"a":{"x":"a&\\n","y":null},"b":1.5,"c":[2,1]}', None]


def test_projects_and_retry_links(spark):
    raw = payloads(spark, {"id": 1, "path_with_namespace": "grp/one", "name": "One"}, {"id": 2})
    assert [tuple(r) for r in decode.projects(raw).collect()] == [(1, "grp/one")]
    responses = payloads(spark, {"id": 55, "runner": None, "finished_at": None}, {"message": "403"})
    links = decode.retry_links(responses.withColumnRenamed("n", "job_id"))
    assert [tuple(r) for r in links.collect()] == [(0, 55)]
    assert [r.n for r in decode.rejected_projects(raw).collect()] == [1]
    assert [r.n for r in decode.rejected_responses(payloads(spark, {"id": 5}, {"message": "403"}, "{", '{"id":"x"}')).collect()] == [1, 2, 3]


def test_reason_round_trip(spark):
    texts = ["job_execution_timeout", "stuck_or_timeout_failure", "runner_system_failure", "script_failure", None]
    df = spark.createDataFrame([(t,) for t in texts], "r STRING")
    kind = decode.reason_kind(F.col("r"))
    got = df.select("r", kind.alias("k"), decode.reason_text(kind, F.col("r")).alias("back")).collect()
    assert [r.k for r in got] == ["timeout", "stuck", "runner_system", "other", None]
    assert all(r.r == r.back for r in got)
