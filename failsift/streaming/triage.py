"""The triage flow as a streaming query.

No event is lost by time: events are told apart by the keys of the store, and an event whose
job record, project or log is not there yet waits in the store and is tried at every trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from failsift.operators import decode, enrich, retry
from failsift.operators.sizing import JobIds
from failsift.plans.triage import judge
from failsift.session import at_once, settle
from failsift.sources.store import append_logs, append_new, fold_state, put_state, read_batch, read_holding, read_state, tidy
from failsift.streaming.budget import decide_batch

# Tables that every batch adds to.
_GROWING = ("event", "job", "job_log", "log_term", "ci_failure", "retry_command")
_EVENT = ["build_id", "build_status", "project_id", "build_finished_at"]


def unique_events(events: DataFrame, root: str, checkpoint: str, name: str = "events") -> DataStreamWriter:
    """The writer that adds each finished event (job, status) to the store once, however
    often and however late it is delivered."""

    def record(batch: DataFrame, batch_no: int) -> None:
        append_new(batch, root, "event", f"{name}-{batch_no}")

    return (
        decode.finished(events)
        .writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def waiting_events(spark: SparkSession, root: str, name: str, batch_no: int) -> DataFrame:
    """The events that the stream left waiting before a batch."""
    return read_state(spark, root, "pending_event", name, batch_no).select(*_EVENT)


def record_batch(
    events: DataFrame,
    jobs: DataFrame,
    projects: DataFrame,
    logs: DataFrame,
    root: str,
    name: str,
    batch_no: int,
    links: DataFrame | None = None,
) -> None:
    """Index, classify and record one batch of finished events and those that wait.

    The batch is bounded by what the source admits per trigger. ``jobs`` has decoded
    records or raw objects (job_id, job_blob); either are cut to the ids of the batch,
    raw ones before they are parsed. The raw logs are read once, into
    the store, and classified from there. An event is complete when its job
    record and project are there and, for a failed job, its log; one whose record
    has no finish time cannot be enriched and is complete as well. Every complete
    event sends a retry or a clear. Given the retry responses so far, the commands
    are decided too.
    """
    spark, batch = events.sparkSession, f"{name}-{batch_no}"
    for table in _GROWING:
        tidy(spark, root, table)
    fold_state(spark, root, "pending_event", name, batch_no)
    append_new(events, root, "event", batch)
    new = read_batch(spark, root, "event", batch).select(*_EVENT, F.lit(False).alias("waited"))
    work = settle(new.union(waiting_events(spark, root, name, batch_no).select("*", F.lit(True).alias("waited"))))
    if work.isEmpty():
        return
    ids = JobIds(work.select(F.col("build_id").alias("job_id")))
    chosen = ids.select_from(jobs)
    batch_jobs = settle(chosen if "finished_at" in jobs.columns else decode.job_records(chosen))
    done = settle(enrich.finished_jobs(work.drop("waited"), batch_jobs, projects))
    stored_jobs = batch_jobs.join(done.select("job_id"), "job_id", "left_semi")
    _, _, broken = at_once(
        spark,
        lambda: append_new(enrich.index_rows(stored_jobs), root, "job", batch),
        lambda: append_logs(done, logs, root, batch),
        lambda: settle(enrich.without_finish_time(work.drop("waited"), batch_jobs)),
    )
    stored_logs = read_holding(ids.rows, root, "job_log").select("job_id", "trace")
    with_log = ids.semi_join(stored_logs.select("job_id"))
    failed = F.col("build_status") == "failed"
    complete = settle(
        done.where(~failed).unionByName(done.where(failed).join(with_log, "job_id", "left_semi"))
    )
    result = judge(complete, stored_logs)
    handled = complete.select(F.col("job_id").alias("build_id"), "build_status").union(
        broken.select("build_id", "build_status")
    )
    # Only what changes is written: events that begin to wait, and those that wait no longer.
    key = ["build_id", "build_status"]
    begin = work.where("NOT waited").join(handled, key, "left_anti")
    end = work.where("waited").join(handled, key, "left_semi")
    changes = begin.select(*_EVENT, F.lit(False).alias("gone")).union(end.select(*_EVENT, F.lit(True).alias("gone")))
    commands = result.commands.unionByName(retry.clear_commands(broken))
    at_once(
        spark,
        lambda: append_new(result.failures, root, "ci_failure", batch),
        lambda: append_new(commands, root, "retry_command", batch),
        lambda: put_state(changes, root, "pending_event", name, batch_no),
    )
    if links is not None:
        decide_batch(read_batch(spark, root, "retry_command", batch), links, root, name, batch_no)


def triage_stream(
    events: DataFrame,
    jobs: Callable[[], DataFrame],
    projects: Callable[[], DataFrame],
    logs: Callable[[], DataFrame],
    root: str,
    checkpoint: str,
    name: str = "triage",
    links: Callable[[], DataFrame] | None = None,
) -> DataStreamWriter:
    """The writer of the streaming triage; the caller sets the trigger and starts it.

    The side tables are read anew for every batch, as they grow while the stream runs.
    """

    def record(batch: DataFrame, batch_no: int) -> None:
        responses = links() if links else None
        record_batch(batch, jobs(), projects(), logs(), root, name, batch_no, responses)

    return (
        decode.finished(events)
        .writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
