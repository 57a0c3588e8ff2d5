"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges to (id, component): the least id that each vertex reaches.

    Every round sends labels over the edges (reduced before the shuffle, so that a
    vertex with many edges is no hot spot) and then jumps to the label's own label;
    chains of n vertices end in about log(n) rounds. Labels are cut from their lineage
    by a checkpoint each round."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        sent = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("component").alias("sent"))
        near = labels.join(sent, "id", "left").select("id", F.col("component").alias("old"), F.least("component", "sent").alias("near"))
        up = labels.select(F.col("id").alias("near"), F.col("component").alias("root"))
        new = materialise(near.join(up, "near", "left").select("id", "old", F.least("near", "root").alias("component")))
        labels = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return labels
