"""The retry budget over streams: counts in the store, each batch decided by the
distributed operator.

A command (root, ts, seq) is taken once. The commands of a trigger are put in the order of
(ts, seq) and follow those of earlier triggers, whatever their time; a count is forgotten by
a clear, a refusal or a failed request only. Counts belong to a stream name, and one stream
of a name writes at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from failsift.operators.retry import count_commands, retry_lineage
from failsift.session import settle
from failsift.sources.store import append_new, fold_state, other_batches, put_state, read_batch, read_holding, read_state, tidy, write_batch


def _command_rows(commands: DataFrame) -> DataFrame:
    rows = commands if "accepted" in commands.columns else commands.withColumn("accepted", F.lit(True))
    return rows.select("root", "ts", "seq", "cmd", "accepted")


def retry_budget_stream(commands: DataFrame, root: str, checkpoint: str, name: str = "budget") -> DataStreamWriter:
    """The writer of the decisions for a stream of (root, ts, seq, cmd, accepted) into the store."""

    def record(batch: DataFrame, batch_no: int) -> None:
        record_decisions(batch, root, batch_no, name)

    return (
        _command_rows(commands)
        .writeStream.foreachBatch(record)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def record_decisions(commands: DataFrame, root: str, batch_no: int, name: str) -> None:
    """Decide one batch on top of the counts that earlier batches of the stream left.

    A count of n is put before the batch as n granted retries; that is ten rows
    per lineage at most. The store holds one count per lineage that has one.
    """
    spark, label = commands.sparkSession, f"{name}-{batch_no}"
    tidy(spark, root, "budget_command")
    fold_state(spark, root, "lineage_count", name, batch_no)
    append_new(_command_rows(commands), root, "budget_command", label)
    fresh = settle(read_batch(spark, root, "budget_command", label))
    lineages = fresh.select("root").distinct()
    counts = read_state(spark, root, "lineage_count", name, batch_no).join(lineages, "root", "left_semi")
    first = fresh.groupBy("root").agg(F.min("ts").alias("first"))
    replayed = counts.join(first, "root").select(
        "root",
        (F.col("first") - F.expr("INTERVAL 1 SECOND")).alias("ts"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("used"))).alias("seq"),
        F.lit("retry").alias("cmd"),
        F.lit(True).alias("accepted"),
    )
    rows = fresh.withColumn("new", F.lit(True)).unionByName(replayed.withColumn("new", F.lit(False)))
    counted = settle(count_commands(rows))
    decided = counted.where(F.col("new") & F.col("decision").isNotNull())
    after = counted.groupBy("root").agg(F.max_by("used", F.struct("ts", "seq")).alias("used"))
    write_batch(
        decided.select("root", "ts", "seq", "decision", "retries_remaining"), root, "retry_decision", label
    )
    put_state(after.select("root", "used", (F.col("used") == 0).alias("gone")), root, "lineage_count", name, batch_no)


def record_links(links: DataFrame, root: str, batch: str) -> None:
    """Add retry responses (job_id, new_job_id) and the roots of the jobs they created.

    A root is the first job known of a lineage; :func:`roots_of` follows it on if an
    earlier link came later.
    """
    spark = links.sparkSession
    append_new(links, root, "retry_link", batch)
    fresh = settle(read_batch(spark, root, "retry_link", batch))
    found = retry_lineage(fresh).where("depth > 0").select("job_id", "root")
    append_new(found, root, "job_root", batch)


def roots_of(spark: SparkSession, root: str, jobs: DataFrame) -> DataFrame:
    """(job_id, root) for distinct ``jobs`` (job_id), by as many steps as links came in batches."""
    found = settle(jobs.select("job_id", F.col("job_id").alias("root")))
    while True:
        asked = found.select(F.col("root").alias("job_id")).distinct()
        known = read_holding(asked, root, "job_root").select(F.col("job_id").alias("root"), F.col("root").alias("next"))
        moved = settle(found.join(known, "root", "left").select("job_id", "next", "root"))
        if moved.where("next IS NOT NULL").isEmpty():
            return found
        found = moved.select("job_id", F.coalesce("next", "root").alias("root"))


def decide_batch(commands: DataFrame, links: DataFrame, root: str, name: str, batch_no: int) -> None:
    """Decide the job-level commands (job_id, ts, cmd) of one batch.

    ``links`` has the responses known so far; a retry without one counts as failed.
    """
    spark, label = commands.sparkSession, f"{name}-{batch_no}"
    record_links(links.join(other_batches(spark, root, "retry_link", label), "job_id", "left_anti"), root, label)
    jobs = settle(commands.select("job_id").distinct())
    answered = read_holding(jobs, root, "retry_link").select("job_id", F.lit(True).alias("accepted"))
    rooted = (
        commands.join(roots_of(spark, root, jobs), "job_id")
        .join(answered, "job_id", "left")
        .select("root", "ts", F.col("job_id").alias("seq"), "cmd", F.coalesce("accepted", F.lit(False)).alias("accepted"))
    )
    record_decisions(rooted, root, batch_no, name)
