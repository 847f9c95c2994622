"""Rows that are new to a table under its unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key. Copies are merged before the shuffle, so a key with very
    many copies weighs no more than any other; among unequal rows the least wins."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    return (
        rows.groupBy(*key)
        .agg(F.min(F.struct(*rest)).alias("row"))
        .select(*[c if c in key else F.col("row")[c].alias(c) for c in rows.columns])
    )


def new_rows(incoming: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """The incoming rows an insert that ignores conflicts would add."""
    return one_per_key(incoming, key).join(existing.select(*key), list(key), "left_anti")


def missing(rows: DataFrame, stored: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows whose key the other table does not hold, such as jobs without a log."""
    return rows.join(stored.select(key), key, "left_anti")
