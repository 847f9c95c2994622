"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import held_out

# Documents that a classifier is fitted on, chosen by a hash of their ids.
MAX_TRAINING_DOCUMENTS = 20_000


def training_documents(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, text, label of at most ``limit`` labelled documents that are not held out.

    A document with several labels has the largest. The chosen ids are few enough to be
    sent to the scan of the documents, so no text moves.
    """
    chosen = (
        labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id")
