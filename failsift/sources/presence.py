"""Filters of the keys in a folder: which folders may hold a key, without reading their rows.

A filter is a table of 64-bit cells. A key picks a cell by the high bits of its hash and sets
``BITS`` bits of it by the low ones, so a key is looked up in one row. At ``BITS_PER_KEY`` about
one absent key in four thousand seems present. Cells are merged by ``bit_or``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 5
BITS_PER_KEY = 24
_SCHEMA = "folder STRING, cell BIGINT, bits BIGINT"


def _hash(key: Iterable[str]) -> Column:
    return F.xxhash64(*[F.col(c) for c in key])


def _mask() -> Column:
    """The bits that the hash ``h`` sets, six bits of it for each."""
    one = lambda i: f"shiftleft(1L, int(shiftrightunsigned(h, {6 * i}) & 63))"
    return F.expr(" | ".join(one(i) for i in range(BITS)))


def _cell(power: int) -> Column:
    return F.expr(f"shiftrightunsigned(h, {64 - power})")


def power_for(rows: int) -> int:
    """The power of two of cells for so many keys."""
    return max(4, (rows * BITS_PER_KEY // 64).bit_length())


def write_filter(rows: DataFrame, key: Iterable[str], folder: str, path: str, power: int) -> None:
    """Write the filter of the keys of ``rows`` under ``path``."""
    cells = rows.select(_hash(key).alias("h")).select(_cell(power).alias("cell"), _mask().alias("bits"))
    merged = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    merged.select(F.lit(folder).alias("folder"), "cell", "bits").write.mode("overwrite").parquet(f"{path}/{folder}")


def folders_that_may_hold(
    spark: SparkSession, rows: DataFrame, key: Iterable[str], path: str, powers: dict[str, int]
) -> set[str]:
    """Of the folders with their filters' powers, those that may hold a key of ``rows``.

    The answer has one row per folder at most.
    """
    hashed = rows.select(_hash(key).alias("h")).distinct()
    found: set[str] = set()
    for power in sorted(set(powers.values())):
        paths = [f"{path}/{f}" for f, p in powers.items() if p == power]
        cells = spark.read.schema(_SCHEMA).parquet(*paths)
        probes = hashed.select(_cell(power).alias("cell"), _mask().alias("mask"))
        hits = cells.join(probes, "cell").where(F.expr("bits & mask = mask"))
        found |= {r.folder for r in hits.select("folder").distinct().collect()}
    return found
