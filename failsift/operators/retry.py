"""The retry budget per lineage and the lineages themselves.

A lineage is a job with the jobs it was retried as. The budget counts retries
along a lineage: below ten the next retry is granted and the count moves on to
the new job, else the retry is refused and the count forgotten. A clear command
and a retry request that failed forget the count as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failsift.functions.fields import breadcrumb
from failsift.operators.upsert import one_per_key
from failsift.session import settle, settle_and_measure

# Fixed value: retries granted per lineage.
MAX_RETRIES = 10


def retry_budget(commands: DataFrame, chunks: int | None = None) -> DataFrame:
    """``decision`` and ``retries_remaining`` for every retry command.

    ``commands`` has root, ts, seq and cmd (retry or clear), and optionally
    ``accepted``, false where the retry request itself failed; further columns
    are kept.
    """
    return count_commands(commands, chunks).where(F.col("cmd") == "retry").drop("used")


def count_commands(commands: DataFrame, chunks: int | None = None) -> DataFrame:
    """All commands with their decision and ``used``, the count the lineage has afterwards.

    With n the number of retries since the count was last forgotten, the n-th
    is granted unless n is a multiple of eleven: the eleventh is refused and
    starts the count anew. A lineage may hold any share of the rows, so the
    commands are range-partitioned by lineage and time into chunks of similar
    size. Each chunk counts on its own, and what a lineage carries over from its
    earlier chunks is added afterwards.
    """
    order = ["root", "ts", "seq"]
    ranged = (
        commands.repartitionByRange(chunks, *order) if chunks else commands.repartitionByRange(*order)
    )
    # The chunk numbers must be the same for both uses below, whatever is run again.
    chunked = settle(ranged.withColumn("chunk", F.spark_partition_id()))

    is_retry = F.col("cmd") == "retry"
    accepted = F.col("accepted") if "accepted" in commands.columns else F.lit(True)
    forgets = (F.col("cmd") == "clear") | (is_retry & ~accepted)
    in_chunk = Window.partitionBy("chunk", "root").orderBy("ts", "seq")
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        chunked.withColumn("_total", F.count_if(is_retry).over(so_far))
        .withColumn("_at_reset", F.when(forgets, F.col("_total")))
        .withColumn("_cut", F.max("_at_reset").over(earlier))
    )

    # At most one lineage runs on into a chunk from the one before, so this has
    # no more rows than there are chunks, which bounds the broadcast.
    carried = _carried(counted)
    number = (
        F.col("_total")
        - F.coalesce("_cut", F.lit(0))
        + F.when(F.col("_cut").isNull(), F.coalesce("_carry", F.lit(0))).otherwise(0)
    )
    before = (number - 1) % (MAX_RETRIES + 1)
    decision = F.when(
        is_retry,
        F.when(before >= MAX_RETRIES, "exceeded").when(~accepted, "request_failed").otherwise("retry"),
    )
    granted = F.col("decision") == "retry"
    return (
        counted.join(F.broadcast(carried), ["chunk", "root"], "left")
        .withColumn("decision", decision)
        .withColumn("used", F.when(granted, (before + 1).cast("bigint")).otherwise(0))
        .withColumn("retries_remaining", F.when(granted, MAX_RETRIES - F.col("used")))
        .select(*commands.columns, "decision", "retries_remaining", "used")
    )


def _carried(counted: DataFrame) -> DataFrame:
    """Retries a lineage brings into a chunk, where there are any."""
    tails = counted.groupBy("root", "chunk").agg(
        (F.max("_total") - F.coalesce(F.max("_at_reset"), F.lit(0))).alias("tail"),
        F.max("_at_reset").isNotNull().alias("reset"),
    )
    earlier = (
        Window.partitionBy("root").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("tail").over(earlier), F.lit(0))
    return (
        tails.withColumn("before", before)
        .withColumn("cut", F.max(F.when(F.col("reset"), F.col("before"))).over(earlier))
        .withColumn("_carry", F.col("before") - F.coalesce("cut", F.lit(0)))
        .where(F.col("_carry") > 0)
        .select("root", "chunk", "_carry")
    )


def retry_lineage(links: DataFrame) -> DataFrame:
    """(job_id, root, depth) for every job named in a link (job_id, new_job_id).

    Each round doubles the distance every job looks back, so a lineage of n jobs
    takes about log2(n) rounds. Jobs that have reached their root take no part in
    later rounds. Every round is stored, so a lost executor costs one round only.
    Jobs on a cycle of links have no root and are left out, as are those behind them;
    :func:`lost_links` names links that a lineage cannot follow.
    """
    parents = links.select(F.col("new_job_id").alias("job_id"), F.col("job_id").alias("root"))
    first = one_per_key(parents, ["job_id"]).select("*", F.lit(1).cast("bigint").alias("depth"))
    known, held = settle_and_measure(first, F.count(F.lit(1)).alias("links"))
    # A look-back longer than the number of links is a walk around a cycle.
    rounds = max(1, (held.get("links", 0) + 1).bit_length() + 1)
    done, open_ = None, known
    for _ in range(rounds):
        step = known.select(
            F.col("job_id").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more")
        )
        moved, held = settle_and_measure(open_.join(step, "root", "left"), F.count("next").alias("open"))
        arrived = moved.where(F.col("next").isNull()).select("job_id", "root", "depth")
        done = arrived if done is None else done.unionByName(arrived)
        open_ = moved.where(F.col("next").isNotNull()).select(
            "job_id", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")
        )
        if not held.get("open"):
            break
        known = done.unionByName(open_)
    roots = (
        links.select("job_id")
        .distinct()
        .join(parents.select("job_id"), "job_id", "left_anti")
        .select("job_id", F.col("job_id").alias("root"), F.lit(0).cast("bigint").alias("depth"))
    )
    return done.unionByName(roots)


def lost_links(links: DataFrame) -> DataFrame:
    """Links (job_id, new_job_id) that the lineage does not use: where two jobs name one
    successor, the one with the larger id, and links on a cycle or behind one."""
    kept = one_per_key(links.select(F.col("new_job_id"), "job_id"), ["new_job_id"])
    reached = retry_lineage(links).where("depth > 0").select(F.col("job_id").alias("new_job_id"))
    used = kept.join(reached, "new_job_id", "left_semi")
    return links.select("job_id", "new_job_id").distinct().join(used, ["job_id", "new_job_id"], "left_anti")


def retry_commands(jobs: DataFrame, hits: DataFrame) -> DataFrame:
    """What each finished job sends to the budget: a retry if it failed with a known
    signature, else a clear. The clear that follows a retry finds the count already
    moved to the new job, so it is left out."""
    hit_jobs = hits.select("job_id").distinct().withColumn("hit", F.lit(True))
    to_retry = (F.col("build_status") == "failed") & F.coalesce("hit", F.lit(False))
    return jobs.join(hit_jobs, "job_id", "left").select(
        "job_id",
        "project_id",
        F.col("finished_at").alias("ts"),
        F.when(to_retry, "retry").otherwise("clear").alias("cmd"),
    )


def clear_commands(events: DataFrame) -> DataFrame:
    """The clear that a finished event sends when its job cannot be enriched."""
    return events.select(
        F.col("build_id").alias("job_id"),
        "project_id",
        F.col("build_finished_at").alias("ts"),
        F.lit("clear").alias("cmd"),
    )


def bookkeeping(commands: DataFrame, links: DataFrame, chunks: int | None = None) -> DataFrame:
    """The budget over job-level commands (job_id, ts, cmd), one per job: the lineage of every
    job is found from the links, and each decision names the new job and what remains."""
    lineage = retry_lineage(links)
    new_job = one_per_key(links.select("job_id", "new_job_id"), ["job_id"])
    rooted = (
        commands.join(lineage, "job_id", "left")
        .join(new_job, "job_id", "left")
        .select(
            F.coalesce("root", "job_id").alias("root"),
            "ts",
            F.col("job_id").alias("seq"),
            "job_id",
            "cmd",
            F.col("new_job_id").isNotNull().alias("accepted"),
            "new_job_id",
        )
    )
    decided = retry_budget(rooted, chunks)
    granted = F.col("decision") == "retry"
    note = (
        F.when(
            granted,
            F.concat(
                F.lit("continued by "),
                F.col("new_job_id").cast("string"),
                F.lit(", left "),
                F.col("retries_remaining").cast("string"),
            ),
        )
        .when(F.col("decision") == "exceeded", "no retry left")
        .otherwise(F.concat(F.lit("no new job for "), F.col("job_id").cast("string")))
    )
    return decided.select(
        "job_id",
        "root",
        "decision",
        F.when(granted, F.col("new_job_id")).alias("new_job_id"),
        "retries_remaining",
        breadcrumb(F.col("job_id").cast("string"), F.lit("finished"), F.lit("failed"), F.lit("retrying"), note).alias(
            "note"
        ),
    )
