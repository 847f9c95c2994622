"""Finished jobs, failure rows and the rows the store takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finished_jobs(events: DataFrame, jobs: DataFrame, projects: DataFrame) -> DataFrame:
    """Finished events joined with their job record and project path.

    The log takes no part, so the shuffle carries narrow rows only. Spark
    broadcasts the project side as long as its measured size allows; a project
    holding most events is otherwise split by the adaptive skew join.
    """
    ev = events.select(
        F.col("build_id").alias("job_id"), "build_status", "project_id"
    )
    return (
        ev.join(jobs.where(F.col("finished_at").isNotNull()), "job_id")
        .join(projects, "project_id")
        .select(
            "job_id",
            "build_status",
            "project_id",
            "project_path",
            "web_url",
            "runner_id",
            "runner_name",
            "created_at",
            "finished_at",
            "failure_reason",
            "job_name",
        )
    )


def without_finish_time(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Finished events that :func:`finished_jobs` sets aside, as their job record has no finish time."""
    unfinished = jobs.where(F.col("finished_at").isNull()).select("job_id")
    return events.join(unfinished, events["build_id"] == unfinished["job_id"], "left_semi")


def failure_rows(jobs: DataFrame, hits: DataFrame) -> DataFrame:
    """One row per failed job and failure type; the date is the finish time."""
    return jobs.join(hits.select("job_id", "type"), "job_id").select(
        "job_id",
        "type",
        F.col("finished_at").alias("job_date"),
        "web_url",
        "runner_id",
        "runner_name",
        "job_name",
        "project_path",
    )


def imported_failures(view: DataFrame) -> DataFrame:
    """Rows of a classified view (job_id, typ, created_at, web_url, runner_id) as failure rows."""
    none = F.lit(None).cast("string")
    return view.select(
        "job_id",
        F.col("typ").alias("type"),
        F.col("created_at").alias("job_date"),
        "web_url",
        F.col("runner_id").cast("bigint").alias("runner_id"),
        none.alias("runner_name"),
        none.alias("job_name"),
        none.alias("project_path"),
    )


def index_rows(jobs: DataFrame) -> DataFrame:
    """Job records as the job table takes them. The creation time stands beside the
    object, so that a search can sort by it without reading JSON."""
    return jobs.select("job_id", F.col("web_url").alias("job_url"), "created_at", "job_blob")
