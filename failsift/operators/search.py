"""Match conditions over normalised logs, and the paged search result.

A condition is a boolean column over the ``norm`` text of a log, so conditions
combine freely and run as one narrow filter. The condition is case- and
accent-blind in the same way as the index, as its text goes through the same
token rule.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failsift.functions.fields import once, or_not_available, raw_log_url
from failsift.functions.text import normalise, terms_of
from failsift.functions.times import api_time, shown_time
from failsift.session import settle

PAGE_SIZE = 50


def with_norm(logs: DataFrame) -> DataFrame:
    """Logs with their normalised text."""
    return logs.withColumn("norm", normalise(F.col("trace")))


def needle(text: str) -> str:
    terms = terms_of(text)
    if not terms:
        raise ValueError("the search text holds no token")
    return " ".join(terms)


def phrase(*texts: str, norm: str = "norm") -> Column:
    """The tokens of the texts, in sequence; several texts are concatenated."""
    return F.col(norm).contains(f" {needle(' '.join(texts))} ")


def prefix(text: str, norm: str = "norm") -> Column:
    """The tokens in sequence, the last of them as the beginning of a token."""
    return F.col(norm).contains(f" {needle(text)}")


def initial(text: str, norm: str = "norm") -> Column:
    """The tokens in sequence at the very start of the log."""
    return F.col(norm).startswith(f" {needle(text)} ")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def but_not(wanted: Column, unwanted: Column) -> Column:
    return wanted & ~unwanted


def matches(logs: DataFrame, condition: Column) -> DataFrame:
    """Ids of the logs that meet the condition; logs without ``norm`` get it on the way."""
    if "norm" in logs.columns:
        return logs.where(condition).select("job_id")
    return with_norm(logs).select("job_id", once(condition).alias("met")).where("met").select("job_id")


def is_search(keyword: str | None) -> bool:
    """A missing or empty keyword, quoted or not, asks for no search at all."""
    return keyword not in (None, "", '""')


def has_tokens(text: str) -> bool:
    return bool(terms_of(text))


def found_jobs(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """(job_id, created_at) of every found job; no other column enters the join."""
    created = (
        F.col("created_at")
        if "created_at" in jobs.columns
        else api_time(F.get_json_object("job_blob", "$.created_at"))
    )
    dated = jobs.select("job_id", created.alias("created_at"))
    return dated.join(found.select("job_id"), "job_id", "left_semi")


def _newest() -> list[Column]:
    return [F.col("created_at").desc(), F.col("job_id").desc()]


def _ranked(fetched: DataFrame, size: int) -> DataFrame:
    """``rank`` and ``has_next`` for at most one page and a row; the window sees these rows only."""
    one_page = Window.partitionBy(F.lit(0))
    return (
        fetched.withColumn("has_next", F.count("*").over(one_page) > size)
        .withColumn("rank", F.row_number().over(one_page.orderBy(*_newest())).cast("bigint"))
        .where(F.col("rank") <= size)
    )


def result_page(results: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page, the newest first by ``rank``, with ``has_next`` on each.

    One row beyond the page is fetched to tell whether another page follows. All rows up to
    the page are fetched with it: for pages far on take :func:`page_after` or :func:`page_by_ranges`.
    """
    start = (max(page, 1) - 1) * size
    return _ranked(results.orderBy(*_newest()).offset(start).limit(size + 1), size)


def page_after(results: DataFrame, after: tuple[datetime, int], size: int = PAGE_SIZE) -> DataFrame:
    """The page that follows the row (created_at, job_id), as the last one of the page before.

    However far on it is, a task keeps one page and one row; and rows that come in front
    while a user turns pages shift nothing.
    """
    at, job_id = F.lit(after[0]), F.lit(after[1])
    older = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("job_id") < job_id))
    return _ranked(results.where(older).orderBy(*_newest()).limit(size + 1), size)


def page_by_ranges(results: DataFrame, page: int, size: int = PAGE_SIZE, parts: int | None = None) -> DataFrame:
    """The same page as :func:`result_page`, read from the ranges of the result that hold it.

    The narrow result is dealt into ranges of the order once and stored; their counts tell
    which of them the page lies in, and only these are sorted.
    """
    dealt = results.repartitionByRange(parts, *_newest()) if parts else results.repartitionByRange(*_newest())
    ranged = settle(dealt.withColumn("_range", F.spark_partition_id()))
    start = (max(page, 1) - 1) * size
    before, skipped, held = 0, None, []
    for number, rows in sorted(map(tuple, ranged.groupBy("_range").agg(F.count("*")).collect())):
        if before + rows > start and before < start + size + 1:
            held.append(number)
            skipped = before if skipped is None else skipped
        before += rows
    some = ranged.where(F.col("_range").isin(held)).drop("_range")
    return _ranked(some.orderBy(*_newest()).offset(start - (skipped or 0)).limit(size + 1), size)


def page_fields(jobs: DataFrame, page: DataFrame) -> DataFrame:
    """The result fields of the jobs of one page, read from the job objects.

    A page has a fixed number of rows at most, so it goes to the jobs and not
    the other way round.
    """
    field = lambda path: F.get_json_object("job_blob", path)
    rows = jobs.drop("created_at").join(F.broadcast(page), "job_id")
    return rows.select(
        "job_id",
        "created_at",
        "job_url",
        field("$.runner.id").cast("bigint").alias("runner_id"),
        field("$.runner.description").alias("runner_name"),
        field("$.name").alias("job_name"),
        "has_next",
        "rank",
    ).orderBy("rank")


def shown(results: DataFrame) -> DataFrame:
    """Result rows as text, with ``N/A`` for a lost runner."""
    return results.withColumns(
        {
            "created_at": shown_time(F.col("created_at")),
            "runner_id": or_not_available(F.col("runner_id")),
            "runner_name": or_not_available(F.col("runner_name")),
            "log_url": raw_log_url(F.col("job_url")),
        }
    )
