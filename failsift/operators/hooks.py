"""Which projects have the job hook, and the hooks to create."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what marks a hook as ours in the audit.
HOOK_MARK = ":8080"


def _hooked(hooks: DataFrame) -> DataFrame:
    return hooks.where(F.col("url").contains(HOOK_MARK)).select("project_id").distinct()


def without_hook(projects: DataFrame, hooks: DataFrame) -> DataFrame:
    return projects.join(_hooked(hooks), "project_id", "left_anti")


def with_hook(projects: DataFrame, hooks: DataFrame) -> DataFrame:
    return projects.join(_hooked(hooks), "project_id", "left_semi")


def newest_first(projects: DataFrame) -> DataFrame:
    """The project listing order."""
    return projects.orderBy(F.col("project_id").desc())


def _settings(projects: DataFrame, url: str, verify: Column) -> DataFrame:
    return projects.select(
        "project_id",
        F.lit(url).alias("url"),
        F.lit(True).alias("job_events"),
        F.lit(False).alias("push_events"),
        verify.alias("enable_ssl_verification"),
    )


def hooks_for_new_projects(events: DataFrame, url: str) -> DataFrame:
    """Hook settings for every created project; TLS is verified for https addresses."""
    created = events.where(F.col("kind") == "project_create")
    return _settings(created, url, F.lit(url).startswith("https://"))


def hooks_from_audit(projects: DataFrame, hooks: DataFrame, url: str) -> DataFrame:
    """Hook settings for every project the audit finds without one; TLS is never verified."""
    return _settings(without_hook(projects, hooks), url, F.lit(False))
