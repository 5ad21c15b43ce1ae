"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, for the ends of the
    edges (columns a and b, long).

    Each round gives a node the least label around it and then the label of
    that label, so long chains shorten by a power of two. Least labels are
    found by partial sums before the exchange, and the joins are plain joins
    that adaptive execution may split, so a node with very many edges is no
    more than many rows. Every round is written to the shared folder.
    """
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = stored(ends.where("a <> b").distinct(), "component-edges")
    labels = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"))
    labels = stored(labels.withColumnRenamed("a", "node"), "component-labels")
    while True:
        around = (
            ends.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        nearer = labels.join(around, "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = stored(
            nearer.join(jump, "next").select("node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("changed")),
            "component-labels",
        )
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels
