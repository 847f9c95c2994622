"""Job events to failure rows and retry commands."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.catalog import active_checks
from failsift.operators import decode, enrich, retry
from failsift.operators.classify import classify
from failsift.operators.sizing import JobIds
from failsift.session import settle


class Triage(NamedTuple):
    jobs: DataFrame
    failures: DataFrame
    commands: DataFrame


def hits_of(failed: DataFrame, logs: DataFrame) -> DataFrame:
    """(job_id, type, message) of the failed jobs.

    Reasons are tested on the job record and logs where they lie; the two never
    meet in a join. The logs of a short list of jobs are picked first, otherwise
    all logs are classified and the small result is joined.
    """
    by_reason = classify(failed, active_checks("reason"))
    log_checks = active_checks("literal") + active_checks("pattern")
    wanted = JobIds(failed)
    chosen = wanted.pick(logs)
    by_log = (
        wanted.semi_join(classify(logs, log_checks)) if chosen is None else classify(chosen, log_checks)
    )
    return by_reason.unionByName(by_log)


def triage(events: DataFrame, jobs: DataFrame, projects: DataFrame, logs: DataFrame) -> Triage:
    """The whole flow for decoded events: finished jobs, their failures, their retry commands.

    The finished jobs and the hits are stored when this is called, both without
    log text, so that the logs are read once however the results are used.
    """
    return judge(settle(enrich.finished_jobs(decode.finished(events), jobs, projects)), logs)


def judge(done: DataFrame, logs: DataFrame) -> Triage:
    """The failures and retry commands of finished jobs."""
    failed = done.where(F.col("build_status") == "failed")
    hits = settle(hits_of(failed, logs))
    return Triage(done, enrich.failure_rows(failed, hits), retry.retry_commands(done, hits))
