"""Connected components by rounds of joins, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialized


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable over edges (a, b) from every node that has one.

    A round takes the smallest label among a node's neighbours, then the label of that label.
    """
    both = materialized(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialized(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "low").alias("low"))
        hop = labels.select(F.col("node").alias("low"), F.col("comp").alias("further"))
        new = low.join(hop, "low").select("node", F.least("low", "further").alias("comp"), (F.least("low", "further") != F.col("comp")).alias("changed"))
        new = materialized(new, "labels")
        labels = new.select("node", "comp")
        if new.where("changed").isEmpty():
            return labels
