"""Choosing rows of a wide table by id without moving the wide rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.session import settle

# A set of ids this long takes some 200 MB as a hash table; a longer one is never broadcast.
MAX_BROADCAST_IDS = 4_000_000


class JobIds:
    """A stored and counted set of job ids."""

    def __init__(self, ids: DataFrame):
        self.rows = settle(ids.select("job_id").distinct())
        self.count, self.low, self.high = self.rows.agg(
            F.count("*"), F.min("job_id"), F.max("job_id")
        ).first()

    def pick(self, wide: DataFrame, limit: int = MAX_BROADCAST_IDS) -> DataFrame | None:
        """The rows of ``wide`` with these ids, or None if the set is too long to broadcast.

        A short set goes to every task, so the wide rows stay where they are, and
        its bounds reach the scan as a range filter. With None the caller reduces
        the wide rows before it joins them.
        """
        if self.count > limit:
            return None
        if self.count == 0:
            return wide.where(F.lit(False))
        in_bounds = wide.where(F.col("job_id").between(self.low, self.high))
        return in_bounds.join(F.broadcast(self.rows), "job_id", "left_semi")

    def semi_join(self, narrow: DataFrame) -> DataFrame:
        return narrow.join(self.rows, "job_id", "left_semi")

    def select_from(self, wide: DataFrame, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
        """The rows with these ids. A set too long for one broadcast is cut into ranges
        that are sent one by one, each to the part of ``wide`` in its range, so the
        wide rows stay where they are whatever the length of the set."""
        picked = self.pick(wide, limit)
        if picked is not None:
            return picked
        parts = 2 * (self.count // limit + 1)
        cuts = self.rows.select(
            F.percentile_approx("job_id", [i / parts for i in range(1, parts)], 100 * parts)
        ).first()[0]
        bounds = sorted({self.low - 1, *cuts, self.high})
        ranges = [(low + 1, high) for low, high in zip(bounds, bounds[1:])]
        return reduce(DataFrame.unionByName, (self._in_range(wide, *r) for r in ranges))

    def _in_range(self, wide: DataFrame, low: int, high: int) -> DataFrame:
        in_range = F.col("job_id").between(low, high)
        return wide.where(in_range).join(F.broadcast(self.rows.where(in_range)), "job_id", "left_semi")
