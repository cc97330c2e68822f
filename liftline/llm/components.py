"""Connected components of a graph given as edges, by joins.

Every node takes the smallest label among its own and its neighbours', then the label of its label, until nothing
changes: about as many rounds as the logarithm of the longest chain. Each round is a checkpoint; both sides of each join
are plain shuffles, so adaptive execution splits a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftline.llm.frames import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one type -> node, root: root is the smallest node that node is linked with, itself included."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(both.filter("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        hooked = checkpointed(labels.join(near.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        jumped = checkpointed(hooked.join(
            hooked.select(F.col("node").alias("root"), F.col("root").alias("top")), "root").select("node", "old", F.col("top").alias("root")))
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels
