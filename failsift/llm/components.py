"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failsift.llm.tables import stored

# Labels of so many nodes are some 30 MB; a longer list is joined by a shuffle.
MAX_BROADCAST_LABELS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the least node.

    In each round a node takes the least of its label, its neighbours' labels and the label
    of its label, so that long chains shrink by halves. Labels are stored once a round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct(), "component-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
    labels = stored(labels, "component-labels")
    sent = F.broadcast if labels.count() <= MAX_BROADCAST_LABELS else lambda df: df
    while True:
        near = (
            both.join(sent(labels.select(F.col("node").alias("b"), "root")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = stored(
            near.join(sent(labels), "node").join(sent(jump), "root").select(
                "node", F.col("root").alias("old"), F.least("root", "near", "next").alias("root")
            ),
            "component-labels",
        )
        if moved.where("root != old").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")
