"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, c for every end of edges (a, b): c is the smallest id reachable.

    Each round gives every vertex the smallest label around it and then follows labels
    (label of label), so paths halve; the label table is written after each round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both, "edges")
    label = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("doc"), "c"), "label")
    while True:
        near = both.join(label.withColumnRenamed("doc", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", "c", F.least("c", "m").alias("m"))
        up = label.select(F.col("doc").alias("m"), F.col("c").alias("up"))
        new = scratch.write(step.join(up, "m", "left").select("doc", F.least("m", "up").alias("c"), F.col("c").alias("old")), "label")
        scratch.drop(label)
        label = new.select("doc", "c")
        label.scratch_path = new.scratch_path
        if new.where("c <> old").isEmpty():
            scratch.drop(both)
            return label
