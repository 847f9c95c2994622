"""Mixing sources to target weights by weighted sampling without replacement.

Sources share a number of words by weight, none above a multiple of its size (the excess
goes to the others). A source gives whole epochs first and then a part of its documents:
each has an exponential key, -ln(u) divided by its quality weight, u from a hash of its id
and a seed, and the smallest keys are taken until their prefix sum reaches the budget.

No source is sorted as a whole. Keys fall into buckets of about ``BUCKET_ROWS`` documents;
bucket sums say which buckets are taken whole, and only the bucket in which the budget ends
is sorted. So one source may hold any part of the rows.

Defined cases: a null text or an empty one has size 0 and takes 0 words. A null source is a
source, last in order. Null ids and repeated rows are documents like others; equal keys go
by id and size. A source without words has target 0. No rows give no rows. Extra columns
are ignored. The cut is at the document whose middle the budget reaches, so a source's
words differ from its target by at most half of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failsift.llm.tables import stored

SOURCE_WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix per word of all sources
MAX_EPOCHS = 2
SEED = "mix-1"
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 0.25 to 1 by the share of letters among the characters that are not blank."""
    dense = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    letters = F.regexp_replace(dense, r"\P{L}+", "")
    share = F.length(letters) / F.greatest(F.length(dense), F.lit(1))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * share, F.lit(0.25))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number between 0 and 1, both excluded, that depends on id and seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sources: DataFrame, weights=SOURCE_WEIGHTS, share: float = SHARE, cap: int = MAX_EPOCHS) -> DataFrame:
    """``target`` and ``weight`` for each row of (source, source_size); one row per source.

    With the sources ordered by the level at which they reach their cap, the common level
    of the uncapped ones follows from running sums: it is the highest one that its own
    source stays below. The table has as many rows as there
    are sources, so its windows run in one task.
    """
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1)
    by_level = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        sources.select("source", "source_size", weight.alias("weight"))
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("reach", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest),
        )
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everything))
    )
    uncapped = F.col("weight") * F.col("level")
    return levels.select(
        "source",
        "source_size",
        "weight",
        F.least(F.coalesce(uncapped, F.col("limit").cast("double")), F.col("limit").cast("double")).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    quality: Column | None = None,
    seed: str = SEED,
    bucket_rows: int = BUCKET_ROWS,
    **shares,
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, epochs, chosen, sort_key per document."""
    sized = stored(
        docs.select(
            "doc_id",
            "source",
            (word_count(F.col("text")) if size is None else size).cast("long").alias("size"),
            (-F.log(uniform(F.col("doc_id"), seed)) / (quality_weight(F.col("text")) if quality is None else quality)).alias(
                "sort_key"
            ),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    plan = (
        targets(per_source.select("source", "source_size"), **shares)
        .join(per_source.select(F.col("source").alias("s"), "documents"), F.col("source").eqNullSafe(F.col("s")))
        .select(
            F.col("source").alias("s"),
            "source_size",
            "target",
            whole.cast("long").alias("epochs"),
            (F.col("target") - whole * F.col("source_size")).alias("budget"),
            F.ceil(F.col("documents") / bucket_rows).alias("buckets"),
        )
    )
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # 1 - exp(-key) keeps the order of the keys and spreads them evenly over 0 to 1.
    rows = rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("sort_key"))) * F.col("buckets")))
    running = Window.partitionBy("b_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy(F.col("source").alias("b_source"), F.col("bucket").alias("b"))
        .agg(F.sum("size").alias("bucket_size"), F.max("budget").alias("b_budget"))
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
        .withColumn("whole", F.col("before") + F.col("bucket_size") <= F.col("b_budget"))
        .where(F.col("before") < F.col("b_budget"))
    )
    placed = rows.join(
        buckets.drop("b_budget", "bucket_size"),
        F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b")),
        "left",
    )
    in_bucket = (
        Window.partitionBy("source", "bucket")
        .orderBy("sort_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    cut = (
        placed.where(~F.col("whole"))
        .withColumn("prefix", F.col("before") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .withColumn("chosen", F.col("prefix") + F.col("size") / 2 <= F.col("budget"))
    )
    others = placed.where(F.coalesce(F.col("whole"), F.lit(True))).withColumn(
        "chosen", F.coalesce(F.col("whole"), F.lit(False)) & (F.col("budget") > 0)
    )
    columns = [
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * (F.col("epochs") + F.col("chosen").cast("long"))).alias("taken"),
        "source",
        "epochs",
        "chosen",
    ]
    return others.select(*columns).unionByName(cut.select(*columns))
