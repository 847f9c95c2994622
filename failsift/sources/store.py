"""The triage store: Parquet tables that take every row once.

A table is a set of folders named by a manifest (:mod:`failsift.sources.manifest`). Writing a
batch again takes the place of what it held, and rows whose key another batch holds are left
out, so a repeated or redelivered batch changes nothing. Key filters
(:mod:`failsift.sources.presence`) tell which folders an append has to look into, and
:func:`tidy` merges folders in tiers, so that their number grows with the logarithm of the
rows and not with the number of batches. One writer at a time.

State tables (``State``) hold one current row per key: batches add changes, the newest row of a
key counts, and :func:`fold_state` keeps a snapshot with few changes behind it.
"""

from __future__ import annotations

import operator
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from failsift import schemas
from failsift.operators.index import term_rows
from failsift.operators.search import with_norm
from failsift.operators.sizing import JobIds
from failsift.operators.upsert import one_per_key
from failsift.session import settle
from failsift.sources import manifest, presence
from failsift.sources.manifest import Entry, Manifest

# Characters of normalised text that one task and one file of the index take.
INDEX_CHARS_PER_PART = 16_000_000
# Rows of a merged folder that one task and one file take.
ROWS_PER_PART = 2_000_000
# Folders of one size class that are merged; a class is so many times as large as the one below.
FANOUT = 4
TIER_ROWS = 10_000
# Changes behind a snapshot before they are merged with each other.
MAX_CHANGES = 8


@dataclass(frozen=True)
class Table:
    schema: str
    key: tuple[str, ...]
    filtered: bool = True
    order: tuple[str, ...] | None = None  # of merged folders, if not the key


@dataclass(frozen=True)
class State(Table):
    """``version`` orders the rows of a key; a row with ``gone`` ends it."""

    version: str = "batch_no"
    filtered: bool = False


TABLES = {
    "ci_failure": Table(schemas.CI_FAILURE, ("job_id", "type")),
    "job": Table(schemas.JOB_TABLE, ("job_id",)),
    "job_log": Table(schemas.JOB_LOG, ("job_id",)),
    "retry_command": Table(schemas.RETRY_COMMAND, ("job_id",)),
    "retry_decision": Table(schemas.RETRY_DECISION, ("root", "ts", "seq"), filtered=False),
    "lineage_count": State(schemas.LINEAGE_COUNT, ("root", "stream")),
    "budget_command": Table(schemas.BUDGET_COMMAND, ("root", "ts", "seq")),
    "event": Table(schemas.FINISHED_EVENT, ("build_id", "build_status")),
    "pending_event": State(schemas.PENDING_EVENT, ("build_id", "build_status", "stream")),
    "retry_link": Table(schemas.RETRY_LINK, ("job_id",)),
    "job_root": Table(schemas.JOB_ROOT, ("job_id",)),
    "log_term": Table(schemas.LOG_TERM, ("term", "job_id", "pos"), filtered=False),
}


def _path(root: str, name: str) -> str:
    return f"{root}/{name}"


def _columns(name: str) -> list[str]:
    return StructType.fromDDL(TABLES[name].schema).fieldNames()


def live(spark: SparkSession, root: str, name: str) -> Manifest:
    """The manifest of a table."""
    return manifest.load(spark, _path(root, name))


def init_store(spark: SparkSession, root: str) -> None:
    """Create the tables that are absent."""
    for name in TABLES:
        if not live(spark, root, name).version:
            manifest.publish(spark, _path(root, name), (), 1)


def read_entries(spark: SparkSession, root: str, name: str, entries: Sequence[Entry]) -> DataFrame:
    """The rows of some folders of a table, with their ``batch``."""
    schema = TABLES[name].schema + ", batch STRING"
    reader = spark.read.schema(schema)
    path = lambda e: f"{_path(root, name)}/data/{e.folder}"
    whole = [path(e) for e in entries if not e.hidden]
    parts = [reader.parquet(*whole)] if whole else []
    parts += [reader.parquet(path(e)).where(~F.col("batch").isin(*e.hidden)) for e in entries if e.hidden]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_entries(spark, root, name, live(spark, root, name).entries)


def read_batch(spark: SparkSession, root: str, name: str, batch: str) -> DataFrame:
    """The rows that one batch added, as it was written."""
    holding = [e for e in live(spark, root, name).entries if batch in e.batches and batch not in e.hidden]
    rows = read_entries(spark, root, name, holding)
    return rows.where(F.col("batch") == batch).drop("batch")


def other_batches(spark: SparkSession, root: str, name: str, batch: str) -> DataFrame:
    entries = [e for e in live(spark, root, name).entries if e.batches != (batch,)]
    return read_entries(spark, root, name, entries).where(F.col("batch") != batch)


def _write_folder(rows: DataFrame, root: str, name: str, version: int, batches: tuple[str, ...], **more) -> Entry | None:
    """Write a folder of rows with their ``batch``, count and bound them on the way."""
    spark, table, path = rows.sparkSession, TABLES[name], _path(root, name)
    folder = f"{version:012d}"
    seen = Observation()
    first = table.key[0]
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(first).alias("low"), F.max(first).alias("high"))
    counted.write.mode("overwrite").parquet(f"{path}/data/{folder}")
    got = seen.get
    if not got.get("rows"):
        return None
    entry = Entry(folder, batches, got["rows"], got["low"], got["high"], **more)
    if table.filtered:
        power = presence.power_for(entry.rows)
        written = spark.read.schema(table.schema).parquet(f"{path}/data/{folder}")
        presence.write_filter(written, table.key, folder, f"{path}/keys", power)
        entry = replace(entry, filter_bits=power)
    return entry


def write_batch(rows: DataFrame, root: str, name: str, batch: str, **more) -> int:
    """Write a whole batch of a table, in place of what it held; gives its number of rows."""
    spark, path = rows.sparkSession, _path(root, name)
    before = manifest.load(spark, path)
    labelled = rows.select(*_columns(name), F.lit(batch).alias("batch"))
    entry = _write_folder(labelled, root, name, before.version + 1, (batch,), **more)
    entries = before.without_batch(batch)
    manifest.publish(spark, path, (*entries, entry) if entry else entries, before.version + 1)
    return entry.rows if entry else 0


def key_ranges(keys: DataFrame, column: str, low: int, high: int, parts: int = 64) -> list[tuple[int, int]]:
    """A few ranges that hold all values of a column: one for each part of ``low`` to ``high``
    that has any, and one for each side, so that a lone far value does not widen the whole."""
    width = (high - low) // parts + 1
    value = F.greatest(F.lit(low - 1), F.least(F.lit(high + 1), F.col(column)))
    found = (
        keys.where(F.col(column).isNotNull())
        .groupBy(F.floor((value - low) / width), value > high)
        .agg(F.min(column), F.max(column))
        .collect()
    )
    return sorted((a, b) for *_, a, b in found)


def may_hold(keys: DataFrame, root: str, name: str, entries: Sequence[Entry]) -> tuple[list[Entry], list[tuple[int, int]]]:
    """The folders that may hold a row with a key of ``keys``, by their bounds and then by their
    filters; and ranges of the first key column that hold all keys."""
    spark, table = keys.sparkSession, TABLES[name]
    if not entries:
        return [], []
    ranges = key_ranges(keys, table.key[0], min(e.low for e in entries), max(e.high for e in entries))
    near = [e for e in entries if any(a <= e.high and e.low <= b for a, b in ranges)]
    powers = {e.folder: e.filter_bits for e in near if e.filter_bits}
    if powers:
        found = presence.folders_that_may_hold(spark, keys, table.key, f"{_path(root, name)}/keys", powers)
        near = [e for e in near if not e.filter_bits or e.folder in found]
    return near, ranges


def read_holding(keys: DataFrame, root: str, name: str, but: str | None = None) -> DataFrame:
    """The rows of the folders that may hold a key of ``keys``, less those of the batch ``but``."""
    spark, column = keys.sparkSession, F.col(TABLES[name].key[0])
    entries = [e for e in live(spark, root, name).entries if e.batches != (but,)]
    holding, ranges = may_hold(keys, root, name, entries)
    rows = read_entries(spark, root, name, holding)
    if not holding:
        return rows
    if but:
        rows = rows.where(F.col("batch") != but)
    # Within a folder the scan skips row groups by the key's bounds.
    return rows.where(reduce(operator.or_, [column.between(a, b) for a, b in ranges]))


def append_new(rows: DataFrame, root: str, name: str, batch: str) -> int:
    """Add the rows whose key is new; gives their number. For tables of narrow rows."""
    table, columns = TABLES[name], _columns(name)
    incoming = settle(one_per_key(rows.select(*columns), table.key))
    stored = read_holding(incoming.select(*table.key), root, name, batch)
    fresh = incoming.join(stored.select(*table.key), list(table.key), "left_anti")
    return write_batch(fresh.sortWithinPartitions(*table.key), root, name, batch)


def append_logs(jobs: DataFrame, logs: DataFrame, root: str, batch: str) -> int:
    """Store and index the logs of the given jobs that have none yet; gives their number.

    ``logs`` (job_id, trace) has one row per job. Which logs are wanted is worked
    out between ids alone, and the logs are then read once.
    """
    spark = logs.sparkSession
    wanted = jobs.select("job_id").distinct()
    stored = read_holding(wanted, root, "job_log", batch).select("job_id")
    waiting = JobIds(wanted.join(stored, "job_id", "left_anti"))
    fresh = waiting.select_from(logs)
    added = write_batch(with_norm(fresh.select("job_id", "trace")), root, "job_log", batch)
    written = read_batch(spark, root, "job_log", batch)
    chars = written.agg(F.sum(F.length("norm"))).first()[0] or 0
    write_index(term_rows(written), root, batch, 1 + chars // INDEX_CHARS_PER_PART)
    return added


def write_index(terms: DataFrame, root: str, batch: str, parts: int = 1) -> int:
    """Write index rows in files that each hold a range of (term, job).

    A look-up of terms or of a prefix skips the other files by their bounds, and a term
    that makes up a large part of all tokens is spread over as many files as it fills.
    """
    laid_out = terms.repartitionByRange(parts, "term", "job_id").sortWithinPartitions("term", "job_id", "pos")
    return write_batch(laid_out, root, "log_term", batch)


def read_index(spark: SparkSession, root: str, *terms: str) -> DataFrame:
    """Index rows; with terms given, those of the terms only."""
    rows = read_table(spark, root, "log_term")
    return rows.where(F.col("term").isin(*terms)) if terms else rows


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(table_name, batches, rows) of every folder of the store, as counted when it was written;
    an empty table has one row without batches."""
    rows = [
        (name, ",".join(sorted(set(e.batches) - set(e.hidden))), e.rows)
        for name in TABLES
        for e in live(spark, root, name).entries or (Entry("", (), 0),)
    ]
    return spark.createDataFrame(rows, "table_name STRING, batches STRING, rows BIGINT")


# Merging


def _merge(spark: SparkSession, root: str, name: str, some: Sequence[Entry], rows: DataFrame, **more) -> Manifest:
    """Put one folder of ``rows``, laid out by key, in the place of some folders."""
    table, path = TABLES[name], _path(root, name)
    before = manifest.load(spark, path)
    order = table.order or table.key
    parts = 1 + sum(e.rows for e in some) // ROWS_PER_PART
    laid_out = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    batches = tuple(dict.fromkeys(b for e in some for b in e.batches if b not in e.hidden))
    entry = _write_folder(laid_out, root, name, before.version + 1, batches, **more)
    merged = {e.folder for e in some}
    entries = tuple(e for e in before.entries if e.folder not in merged)
    made = manifest.publish(spark, path, (*entries, entry) if entry else entries, before.version + 1)
    manifest.expire(spark, path)
    return made


def _tier(rows: int) -> int:
    tier = 0
    while rows >= TIER_ROWS * FANOUT**tier:
        tier += 1
    return tier


def tidy(spark: SparkSession, root: str, name: str) -> int:
    """Merge folders of similar size while there are ``FANOUT`` of them; gives the number of merges.

    Every row is merged about once per size class. Readers that have begun end on the
    folders they have seen.
    """
    merges = 0
    while True:
        tiers = defaultdict(list)
        for e in live(spark, root, name).entries:
            tiers[_tier(e.rows)].append(e)
        full = [tier for tier, some in sorted(tiers.items()) if len(some) >= FANOUT]
        if not full:
            return merges
        some = tiers[full[0]]
        _merge(spark, root, name, some, read_entries(spark, root, name, some))
        merges += 1


# State


def _newest(rows: DataFrame, table: State) -> DataFrame:
    rest = [c for c in rows.columns if c not in table.key and c != table.version]
    newest = rows.groupBy(*table.key).agg(F.max(F.struct(table.version, *rest)).alias("row"))
    return newest.select(*[c if c in table.key else F.col("row")[c].alias(c) for c in rows.columns])


def _of_stream(spark: SparkSession, root: str, name: str, stream: str, before: int | None = None) -> list[Entry]:
    entries = [e for e in live(spark, root, name).entries if e.stream == stream]
    return [e for e in entries if before is None or e.last < before]


def put_state(rows: DataFrame, root: str, name: str, stream: str, batch_no: int) -> int:
    """Add the changes of a batch of a stream: rows of the table less ``stream`` and version; ``gone`` ends a key."""
    table = TABLES[name]
    filled = rows.withColumns({"stream": F.lit(stream), table.version: F.lit(batch_no).cast("bigint")})
    return write_batch(filled, root, name, f"{stream}-{batch_no}", stream=stream, last=batch_no)


def read_state(spark: SparkSession, root: str, name: str, stream: str, before: int) -> DataFrame:
    """The current rows of a stream as batch ``before`` finds them."""
    rows = read_entries(spark, root, name, _of_stream(spark, root, name, stream, before)).drop("batch")
    return _newest(rows, TABLES[name]).where(~F.col("gone"))


def fold_state(spark: SparkSession, root: str, name: str, stream: str, before: int) -> bool:
    """Bound what reading the state takes; called by a batch before it adds changes.

    Changes that outgrow the snapshot become a new one with it, without rows that are gone;
    many small ones are merged among themselves. So a snapshot is written when as many rows
    have changed as it holds, and a key has one row in it however long the stream runs.
    """
    entries = _of_stream(spark, root, name, stream, before)
    changes = [e for e in entries if not e.snapshot]
    base = [e for e in entries if e.snapshot]
    if len(changes) < MAX_CHANGES and sum(e.rows for e in changes) <= max(TIER_ROWS, sum(e.rows for e in base)):
        return False
    if len(changes) < 2 and not base:
        return False
    whole = sum(e.rows for e in changes) >= sum(e.rows for e in base)
    some = entries if whole else changes
    label = F.lit(f"{stream}-{max(e.last for e in some)}")
    rows = _newest(read_entries(spark, root, name, some).drop("batch"), TABLES[name])
    rows = (rows.where(~F.col("gone")) if whole else rows).withColumn("batch", label)
    _merge(spark, root, name, some, rows, stream=stream, last=max(e.last for e in some), snapshot=whole)
    return True
