"""Readers for events, job and project listings, hooks, logs and build tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failsift import schemas
from failsift.functions.fields import is_uri, raw_log_url
from failsift.functions.times import api_time

Paths = str | Sequence[str]


def payloads(spark: SparkSession, paths: Paths, whole_files: bool = False) -> DataFrame:
    """JSON texts as ``payload``: one per line, or one per file."""
    return spark.read.text(paths, wholetext=whole_files).withColumnRenamed("value", "payload")


def payload_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines of the files that arrive in a folder."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .text(path)
        .withColumnRenamed("value", "payload")
    )


def payload_of(messages: DataFrame) -> DataFrame:
    """The payloads of a message source with a binary ``value`` column."""
    return messages.select(F.col("value").cast("string").alias("payload"))


def _log_id(path: Column) -> Column:
    """The job id in ``<id>.log`` or ``.../<id>/raw``."""
    return F.regexp_extract(path, r"(\d+)(?:\.log|/raw)$", 1).try_cast("bigint")


def _log_files(spark: SparkSession, paths: Paths) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(_log_id(F.col("path")).alias("job_id"), "path", "content")
    )


def logs(spark: SparkSession, paths: Paths) -> DataFrame:
    """(job_id, trace) of the log files that are valid UTF-8."""
    files = _log_files(spark, paths).where(F.col("job_id").isNotNull())
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select(
        "job_id", F.col("content").cast("string").alias("trace")
    )


def rejected_logs(spark: SparkSession, paths: Paths) -> DataFrame:
    """(job_id, path) of the log files that are not valid UTF-8 or name no job."""
    unread = F.col("job_id").isNull() | ~F.is_valid_utf8(F.col("content").cast("string"))
    return _log_files(spark, paths).where(unread).select("job_id", "path")


def job_listing(spark: SparkSession, paths: Paths) -> DataFrame:
    """Listed jobs from JSON lines; many pages are read as one table.

    The listing names the project of a job in its pipeline.
    """
    blob = F.col("value")
    job = F.from_json(blob, schemas.JOB)
    return (
        spark.read.text(paths)
        .select(job.alias("job"), blob.alias("job_blob"))
        .select(
            F.col("job.id").alias("job_id"),
            F.col("job.pipeline.project_id").alias("project_id"),
            F.col("job.status").alias("status"),
            api_time(F.col("job.created_at")).alias("created_at"),
            F.col("job.web_url").alias("web_url"),
            "job_blob",
        )
        .where(F.col("job_id").isNotNull())
    )


def rejected_listing(spark: SparkSession, paths: Paths) -> DataFrame:
    """The lines that :func:`job_listing` leaves out, as ``job_blob``."""
    lines = spark.read.text(paths).withColumnRenamed("value", "job_blob")
    return lines.where(F.from_json("job_blob", schemas.JOB)["id"].isNull())


def project_listing(spark: SparkSession, paths: Paths) -> DataFrame:
    """(project_id, path) of all listed projects."""
    return (
        spark.read.schema(schemas.PROJECT)
        .json(paths)
        .select(F.col("id").alias("project_id"), F.col("path_with_namespace").alias("path"))
    )


def hook_listing(spark: SparkSession, paths: Paths) -> DataFrame:
    """(project_id, hook_id, url) of the hooks of all projects."""
    return (
        spark.read.schema(schemas.HOOK)
        .json(paths)
        .select("project_id", F.col("id").alias("hook_id"), "url")
    )


def builds(
    spark: SparkSession,
    url: str,
    table: str,
    ids: tuple[int, int],
    parts: int,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """The build table of a relational database, read in ranges of its id.

    Filters on the result are pushed to the database.
    """
    return spark.read.jdbc(
        url,
        table,
        column="id",
        lowerBound=ids[0],
        upperBound=ids[1],
        numPartitions=parts,
        properties=properties or {},
    )


def log_urls(jobs: DataFrame) -> DataFrame:
    """(job_id, log_url) of the jobs with a valid address."""
    return jobs.where(is_uri(F.col("job_url"))).select(
        "job_id", raw_log_url(F.col("job_url")).alias("log_url")
    )
