"""Match failure reasons and logs against the signature catalog in one scan.

Every check is a column over the row at hand, so classification is a narrow
step: the log text is read once, never shuffled and dropped before any join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failsift.catalog import Check, active_checks
from failsift.schemas import STORED_LABELS


def _predicates(checks: Sequence[Check], reason: Column, log: Column) -> dict[tuple[str, str], Column]:
    """One predicate per distinct (code, message); entries sharing both are any-of."""
    found: dict[tuple[str, str], Column] = {}
    for check in checks:
        key = (check.code, check.message)
        test = F.coalesce(check.test(reason, log), F.lit(False))
        found[key] = found[key] | test if key in found else test
    return found


def classify(
    jobs: DataFrame,
    checks: Sequence[Check] | None = None,
    keys: Sequence[str] = ("job_id",),
    reason: str = "failure_reason",
    log: str = "trace",
) -> DataFrame:
    """(keys, type, message) for every check each job meets.

    Reason checks need no log and log checks no reason; a column the checks do
    not use may be absent from ``jobs``.
    """
    return (
        jobs.select(*keys, F.explode(F.array(*_hits(jobs, checks, reason, log))).alias("hit"))
        .where(F.col("hit").isNotNull())
        .select(*keys, "hit.type", "hit.message")
    )


def unclassified(
    jobs: DataFrame,
    checks: Sequence[Check] | None = None,
    keys: Sequence[str] = ("job_id",),
    reason: str = "failure_reason",
    log: str = "trace",
) -> DataFrame:
    """Keys of the jobs that meet no check."""
    found = F.array_compact(F.array(*_hits(jobs, checks, reason, log)))
    return jobs.select(*keys, F.explode_outer(found).alias("hit")).where(F.col("hit").isNull()).select(*keys)


def _hits(jobs: DataFrame, checks: Sequence[Check] | None, reason: str, log: str) -> list[Column]:
    """One (type, message) per check, null where it is not met."""
    checks = active_checks() if checks is None else checks
    return [
        F.when(test, F.struct(F.lit(code).alias("type"), F.lit(message).alias("message")))
        for (code, message), test in _predicates(checks, *_columns(jobs, reason, log)).items()
    ]


def _columns(jobs: DataFrame, reason: str, log: str) -> tuple[Column, Column]:
    absent = F.lit(None).cast("string")
    return (
        F.col(reason) if reason in jobs.columns else absent,
        F.col(log) if log in jobs.columns else absent,
    )


def retry_candidates(failed_jobs: DataFrame, hits: DataFrame) -> DataFrame:
    """Failed jobs with ``retry`` true where at least one signature was met."""
    hit_jobs = hits.select("job_id").distinct().withColumn("retry", F.lit(True))
    return failed_jobs.join(hit_jobs, "job_id", "left").withColumn(
        "retry", F.coalesce("retry", F.lit(False))
    )


def label_gaps(failures: DataFrame, labels: Sequence[str] = STORED_LABELS) -> DataFrame:
    """Failure types outside the stored label set, with their number of rows."""
    return (
        failures.where(~F.col("type").isin(*labels))
        .groupBy("type")
        .agg(F.count("*").alias("failures"))
    )
