"""A corpus from raw documents: toxicity, quality, near-duplicates, decontamination, mixing.

Each stage takes all documents its predecessor kept, as (spark, docs, sf_dir), and is written
as a table in the shared folder before the next one reads it. All but the last return the
columns of documents. Rows are kept or dropped by themselves: where a stage works by id and a
row has none, or shares it with others, a hash of its columns stands for it. Of equal rows the
near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failsift.llm import decontamination, mixing, near_dedup, quality, toxicity
from failsift.llm.tables import small_batches, stored, table

# A list of ids this long is some 40 MB as a hash table; a longer one is joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


# The key of a row: stages that judge rows by an id take this one.
ROW = "_pipeline_row"


def listed_as(ids: DataFrame, name: str, purpose: str) -> DataFrame:
    """The stored ids (doc_id) as column ``name``, broadcast up to a counted length."""
    ids = stored(ids.select(F.col("doc_id").alias(name)), purpose)
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of each row: its id where one row has it, else a hash of its columns."""
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    several = listed_as(several, "_repeated", "pipeline-repeated-ids")
    own = F.when(F.col("_repeated").isNull(), F.col("doc_id").cast("long"))
    key = F.coalesce(own, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return docs.join(several, F.col("doc_id") == F.col("_repeated"), "left").withColumn(ROW, key).drop("_repeated")


def with_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def by_id(rows: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
    """The keyed rows whose key is (or is not) among the distinct ``ids``."""
    return rows.join(listed_as(ids, "_listed", "pipeline-ids"), F.col(ROW) == F.col("_listed"), "left_semi" if keep else "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class the row with the least key; of its repeated rows one."""
    rows = keyed(docs)
    classes = stored(near_dedup.near_duplicates(with_ids(rows)), "pipeline-classes")
    others = classes.groupBy("doc_id").agg(
        F.max((F.col("doc_id") != F.col("class_id")).cast("int")).alias("other"), F.count("*").alias("n")
    )
    kept = by_id(rows, others.where("other = 1"), keep=False)
    repeated = stored(others.where("other = 0 AND n > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept.drop(ROW)
    equal = by_id(kept, repeated, keep=True)
    first = equal.groupBy(ROW).agg(*[F.first(f"`{c}`").alias(c) for c in docs.columns])
    return by_id(kept, repeated, keep=False).unionByName(first).drop(ROW)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Items of a few words stand in clean documents, too: they do not decide here."""
    rows = keyed(docs)
    found = decontamination.leaks(with_ids(rows), table(spark, sf_dir, "benchmark"), min_words=decontamination.FUZZY_WORDS)
    leaked = found.select("doc_id").distinct()
    return by_id(rows, leaked, keep=False).drop(ROW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

ORACLE_SQL = None  # classifiers and sampled signatures have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
