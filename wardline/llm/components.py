"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import landed


def components(edges: DataFrame) -> DataFrame:
    """id, comp for every node of ``edges`` (columns a, b): comp is the smallest id it can reach.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so paths
    shorten by a factor of two or more.  Rounds are written to the shared scratch folder."""
    both = landed(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = landed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        )
        taken = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        step = landed(
            taken.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")),
            "labels",
        )
        labels = step.select("id", "comp")
        if step.where("comp <> old").isEmpty():
            return labels
