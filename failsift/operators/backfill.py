"""Selection of listed jobs by project, status and date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The projects and statuses a backfill covers.
PROJECTS = (1,)
STATUSES = ("failed", "success")


def in_range(
    jobs: DataFrame,
    start: datetime,
    end: datetime,
    project_ids: Sequence[int] = PROJECTS,
    statuses: Sequence[str] = STATUSES,
) -> DataFrame:
    """Jobs created from ``start`` to ``end``, both included."""
    return jobs.where(
        F.col("status").isin(*statuses)
        & F.col("project_id").isin(*project_ids)
        & F.col("created_at").between(F.lit(start), F.lit(end))
    )


def page_age(jobs: DataFrame, start: datetime, end: datetime, page: str = "page") -> DataFrame:
    """How a page-by-page fetch would judge each page of the listing."""
    created = F.col("created_at")
    ages = jobs.groupBy(page).agg(
        F.count("*").alias("jobs"),
        F.bool_and(created > F.lit(end)).alias("all_young"),
        F.bool_and(created < F.lit(start)).alias("all_old"),
    )
    return ages.select(
        page,
        "jobs",
        F.when(F.col("all_young"), "too_young")
        .when(F.col("all_old"), "too_old")
        .otherwise("found")
        .alias("age"),
    )
