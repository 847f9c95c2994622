"""Backfill of the archive: stage listed jobs, then store the logs still missing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from failsift.operators import backfill, decode, enrich
from failsift.operators.upsert import missing
from failsift.sources.store import append_logs, append_new, read_table


def stage_jobs(listing: DataFrame, root: str, start: datetime, end: datetime, batch: str) -> int:
    """Add the listed jobs of the date range to the job table."""
    chosen = backfill.in_range(listing, start, end)
    rows = enrich.index_rows(decode.job_records(chosen.select("job_blob")))
    return append_new(rows, root, "job", batch)


def backlog(spark: SparkSession, root: str) -> DataFrame:
    """Stored jobs without a stored log."""
    return missing(read_table(spark, root, "job").select("job_id", "job_url"), read_table(spark, root, "job_log"))


def drain_backlog(logs: DataFrame, root: str, batch: str) -> int:
    """Store and index the logs of the jobs that have none yet."""
    return append_logs(backlog(logs.sparkSession, root), logs, root, batch)
