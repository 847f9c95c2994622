"""Grep through an index: signatures of character runs per block of a log.

A log is stored in blocks of ``BLOCK_LINES`` lines. Next to them, in a table of its own, stands
the signature of each block: the distinct hashes, of ``SIGNATURE_BITS`` bits, of its runs of
three characters. From a pattern follow runs that each matching line must hold; only blocks
whose signature has all of them are read. A signature may promise too much, never too little,
and a pattern from which nothing follows reads all blocks, so no line is lost.

Defined cases: ``job_id`` is the key of the logs. A log without a match, empty or null, yields
one row with an empty line and number 0. Logs without id are left out. No logs give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from failsift.operators.sizing import MAX_BROADCAST_IDS, JobIds
from failsift.session import settle

BLOCK_LINES = 64
GRAM = 3
SIGNATURE_BITS = 15


def _hashed(gram: Column) -> Column:
    return F.xxhash64(gram).bitwiseAND(F.lit((1 << SIGNATURE_BITS) - 1)).cast("short")


def blocks_of(logs: DataFrame) -> DataFrame:
    """(job_id, block, text) of every log; one block with a null text if it has no lines."""
    lines = F.split(F.regexp_replace("trace", r"\n\z", ""), "\n")
    cut = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / BLOCK_LINES).cast("int")),
        lambda i: F.struct(i.alias("block"), F.array_join(F.slice("lines", i * BLOCK_LINES + 1, BLOCK_LINES), "\n").alias("text")),
    )
    none = F.array(F.struct(F.lit(0).alias("block"), F.lit(None).cast("string").alias("text")))
    return (
        logs.where(F.col("job_id").isNotNull())
        .select("job_id", F.explode(F.array(F.when(F.length("trace") > 0, lines))).alias("lines"))
        .select("job_id", F.explode(F.when(F.col("lines").isNull(), none).otherwise(cut)).alias("b"))
        .select("job_id", "b.block", "b.text")
    )


def write_grep_index(logs: DataFrame, folder: str) -> None:
    """Blocks and signatures of the logs, ordered by job, so that bounds of ids skip files."""
    ordered = blocks_of(logs).repartitionByRange("job_id", "block").sortWithinPartitions("job_id", "block")
    ordered.write.mode("overwrite").parquet(f"{folder}/blocks")
    blocks = logs.sparkSession.read.parquet(f"{folder}/blocks")
    grams = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    signed = blocks.select("job_id", "block", F.array_sort(F.array_distinct(F.transform(grams, _hashed))).alias("signature"))
    signed.write.mode("overwrite").parquet(f"{folder}/signatures")


_ENDS_RUN = set("dDwWsSbBAzZGhHvVRtnrfea")  # letters of escapes that stand for no fixed character


def required_runs(pattern: str) -> list[list[str]] | None:
    """Per alternative of the pattern, literal runs that a match of it holds; None if unknown.

    Whatever may be optional, or is not plainly a literal, ends a run and adds nothing. Flags,
    look-around, quotes and numbered or named escapes are not looked into.
    """
    alternatives, runs, run, depth, i = [], [], "", 0, 0
    while i <= len(pattern):
        c = pattern[i] if i < len(pattern) else "|"
        literal = None
        if c == "|" and depth == 0:
            alternatives.append([r for r in [*runs, run] if len(r) >= GRAM])
            runs, run, i = [], "", i + 1
            continue
        if c == "|" and i == len(pattern):
            return None  # a group that does not end
        if c == "\\":
            i += 1
            if i == len(pattern) or (pattern[i].isalnum() and pattern[i] not in _ENDS_RUN):
                return None
            literal = None if pattern[i].isalnum() else pattern[i]
        elif c == "[":
            end = pattern.find("]", i + 1)
            body = pattern[i + 1 : end]
            if end < 0 or not body.strip("^") or "[" in body or "\\" in body or "&&" in body:
                return None
            i = end
        elif c == "(":
            if pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
                return None
            depth += 1
            i += 2 if pattern.startswith("(?:", i) else 0
        elif c == ")":
            depth -= 1
            if depth < 0:
                return None
        elif c in "*?{":
            run = run[:-1]  # the character before may be missing
            if c == "{":
                i = pattern.find("}", i)
                if i < 0:
                    return None
        elif c not in ".^$+":
            literal = c
        if literal is not None and depth == 0:
            run += literal
        else:
            runs, run = [*runs, run], ""
        i += 1
    return alternatives if all(alternatives) else None


def may_match(pattern: str) -> Column:
    """The condition on ``signature`` that every block with a matching line meets."""
    alternatives = required_runs(pattern)
    if alternatives is None:
        return F.lit(True)
    grams = [sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)}) for runs in alternatives]
    holds = [reduce(lambda a, b: a & b, (F.array_contains("signature", _hashed(F.lit(g))) for g in own)) for own in grams]
    return reduce(lambda a, b: a | b, holds)


def candidate_blocks(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(job_id, block) of the blocks that may hold a matching line."""
    return spark.read.parquet(f"{folder}/signatures").where(may_match(pattern)).select("job_id", "block")


def grep_indexed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The rows of :func:`failsift.operators.loglines.grep`, from the blocks that may match.

    The text of blocks is never shuffled: ids go to where the blocks lie.
    """
    wanted = settle(candidate_blocks(spark, folder, pattern))
    chosen = JobIds(wanted).select_from(spark.read.parquet(f"{folder}/blocks"))
    if wanted.count() <= MAX_BROADCAST_IDS:
        chosen = chosen.join(F.broadcast(wanted), ["job_id", "block"], "left_semi")
    numbered = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct((F.col("block") * BLOCK_LINES + i + 1).cast("bigint").alias("line_no"), line.alias("line")),
    )
    matching = F.filter(numbered, lambda l: l["line"].rlike("(?d)" + pattern))
    found = settle(chosen.select("job_id", F.explode(matching).alias("l")).select("job_id", "l.line_no", "l.line"))
    jobs = spark.read.parquet(f"{folder}/signatures").where("block = 0").select("job_id")
    misses = jobs.join(found.select("job_id").distinct(), "job_id", "left_anti").select(
        "job_id", F.lit(0).cast("bigint").alias("line_no"), F.lit("").alias("line")
    )
    return found.unionByName(misses).select(
        "job_id", "line_no", F.concat(F.col("job_id").cast("string"), F.lit(":"), F.col("line")).alias("line")
    )
