"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, from links (a, b) of longs.

    Each round takes the smallest label among a node's neighbours, then the
    label of that label, so chains halve; a star is done in one round. Every
    round is written to the shared folder. Nodes without a link are absent.
    """
    pairs = links.select("a", "b").where("a != b")
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("m"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        moved = cut_lineage(
            low.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("far", "next")).alias("root"))
        )
        labels = moved.select("node", "root")
        if moved.where("root != old").isEmpty():
            return labels
