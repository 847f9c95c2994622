"""Typed records out of raw JSON text, with rejected rows kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failsift import schemas
from failsift.functions.fields import canonical_json, has_keys, is_json_text, is_uri, once
from failsift.functions.times import api_time, event_time


_EVENT_KEYS = ["build_id", "build_status", "project_id", "build_finished_at"]


def _parsed_events(raw: DataFrame, payload: str) -> DataFrame:
    """The raw rows with the parsed event and whether it is valid: all four keys are
    present and well typed, and only the finish time may be null."""
    text = F.col(payload)
    parsed = F.struct(
        F.from_json(text, schemas.JOB_EVENT).alias("ev"),
        (has_keys(text, _EVENT_KEYS) & is_json_text(text, "build_status")).alias("whole"),
    )
    ev, finish = F.col("parsed.ev"), F.col("finish")
    valid = (
        F.col("parsed.whole")
        & ev["build_id"].isNotNull()
        & ev["project_id"].isNotNull()
        & (ev["build_finished_at"].isNull() | finish.isNotNull())
    )
    return (
        raw.select("*", once(parsed).alias("parsed"))
        .select("*", once(event_time(ev["build_finished_at"])).alias("finish"))
        .select(*raw.columns, ev.alias("ev"), "finish", F.coalesce(valid, F.lit(False)).alias("valid"))
    )


def job_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """Decoded job events; the other columns of ``raw`` are kept."""
    keep = [c for c in raw.columns if c != payload]
    return (
        _parsed_events(raw, payload)
        .where("valid")
        .select(
            *keep,
            "ev.build_id",
            "ev.build_status",
            "ev.project_id",
            F.col("finish").alias("build_finished_at"),
        )
    )


def rejected_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The raw rows :func:`job_events` leaves out."""
    return _parsed_events(raw, payload).where(~F.col("valid")).select(*raw.columns)


def system_events(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """``kind`` is project_create, other_project or other; decoding never fails."""
    keep = [c for c in raw.columns if c != payload]
    text = F.col(payload)
    parsed = F.struct(
        F.from_json(text, schemas.SYSTEM_EVENT).alias("ev"), is_json_text(text, "event_name").alias("named")
    )
    name, project = F.col("parsed.ev.event_name"), F.col("parsed.ev.project_id")
    is_project = F.col("parsed.named") & name.isNotNull() & project.isNotNull()
    return raw.select(*keep, once(parsed).alias("parsed")).select(
        *keep,
        F.when(is_project & (name == schemas.EVENT_PROJECT_CREATE), "project_create")
        .when(is_project, "other_project")
        .otherwise("other")
        .alias("kind"),
        F.when(is_project, project).alias("project_id"),
    )


_JOB_KEYS = ["id", "web_url", "created_at", "name"]


def _parsed_jobs(raw: DataFrame, blob: str) -> DataFrame:
    """The raw rows with the parsed job and whether it is valid. A runner may be absent
    or null, but a runner object must have an id and a description."""
    text = F.col(blob)
    parsed = F.struct(
        F.from_json(text, schemas.JOB).alias("job"),
        F.get_json_object(text, "$.runner").alias("runner"),
        (has_keys(text, _JOB_KEYS) & is_json_text(text, "web_url", "created_at", "name")).alias("whole"),
    )
    job, runner = F.col("parsed.job"), F.col("parsed.runner")
    created, finished_at = F.col("times.created"), F.col("times.finished")
    times = F.struct(
        api_time(job["created_at"]).alias("created"), api_time(job["finished_at"]).alias("finished")
    )
    valid = (
        F.col("parsed.whole")
        & job["id"].isNotNull()
        & is_uri(job["web_url"])
        & created.isNotNull()
        & (job["finished_at"].isNull() | finished_at.isNotNull())
        & (runner.isNull() | has_keys(runner, ["id", "description"]))
    )
    return (
        raw.select("*", once(parsed).alias("parsed"))
        .select("*", once(times).alias("times"))
        .select(*raw.columns, job.alias("job"), "times", F.coalesce(valid, F.lit(False)).alias("valid"))
    )


def job_records(raw: DataFrame, blob: str = "job_blob") -> DataFrame:
    """Decoded job records, with the whole object in canonical form as ``job_blob``."""
    return (
        _parsed_jobs(raw.select(blob), blob)
        .where("valid")
        .select(
            F.col("job.id").alias("job_id"),
            "job.web_url",
            F.col("job.runner.id").alias("runner_id"),
            F.col("job.runner.description").alias("runner_name"),
            F.col("times.created").alias("created_at"),
            F.col("times.finished").alias("finished_at"),
            "job.failure_reason",
            F.col("job.name").alias("job_name"),
            "job.status",
            canonical_json(F.col(blob)).alias("job_blob"),
        )
    )


def rejected_jobs(raw: DataFrame, blob: str = "job_blob") -> DataFrame:
    """The raw rows :func:`job_records` leaves out."""
    return _parsed_jobs(raw, blob).where(~F.col("valid")).select(*raw.columns)


def projects(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(project_id, project_path) from project records."""
    project = F.from_json(payload, schemas.PROJECT)
    return raw.select(
        project["id"].alias("project_id"), project["path_with_namespace"].alias("project_path")
    ).where(F.col("project_id").isNotNull() & F.col("project_path").isNotNull())


def retry_links(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """(job_id, new_job_id) from retry responses; a failed request has none."""
    return raw.select(
        "job_id", F.from_json(payload, schemas.RETRY_RESULT)["id"].alias("new_job_id")
    ).where(F.col("new_job_id").isNotNull())


def rejected_projects(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The raw rows :func:`projects` leaves out."""
    project = F.from_json(payload, schemas.PROJECT)
    whole = project["id"].isNotNull() & project["path_with_namespace"].isNotNull()
    return raw.where(~F.coalesce(whole, F.lit(False)))


def rejected_responses(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """The raw rows :func:`retry_links` leaves out: failed requests and texts it cannot read."""
    return raw.where(F.from_json(payload, schemas.RETRY_RESULT)["id"].isNull())


def reason_kind(reason: Column) -> Column:
    """Named failure reasons by name, any other text as ``other``."""
    return (
        F.when(reason == schemas.REASON_TIMEOUT, "timeout")
        .when(reason == schemas.REASON_STUCK, "stuck")
        .when(reason == schemas.REASON_RUNNER, "runner_system")
        .when(reason.isNotNull(), "other")
    )


def reason_text(kind: Column, other: Column) -> Column:
    """The way back: the reason text of a kind."""
    return (
        F.when(kind == "timeout", schemas.REASON_TIMEOUT)
        .when(kind == "stuck", schemas.REASON_STUCK)
        .when(kind == "runner_system", schemas.REASON_RUNNER)
        .otherwise(other)
    )


def finished(events: DataFrame) -> DataFrame:
    """Events of jobs that have a finish time."""
    return events.where(F.col("build_finished_at").isNotNull())


def dispatch(events: DataFrame) -> DataFrame:
    """What a finished job leads to: all are indexed, failed ones are classified too."""
    failed = F.col("build_status") == schemas.STATUS_FAILED
    return finished(events).select(
        "*",
        F.when(failed, "failed").otherwise("other").alias("status_kind"),
        F.lit(True).alias("to_index"),
        failed.alias("to_classify"),
    )
