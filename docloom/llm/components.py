"""Connected components of a links table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import saved


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after merging the labels that links (a, b) of nodes join; a merged label is its smallest.

    Each round hooks every label to its smallest neighbour and follows the hooks to their end
    by pointer jumping; then the links are contracted to the labels that remain.
    """
    one = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    two = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    edges = saved(links.join(one, "a").join(two, "b").where("la <> lb").select("la", "lb").distinct(), "links")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        hooks = saved(both.groupBy("la").agg(F.min("lb").alias("to")).select(F.col("la").alias("from"), F.least("la", "to").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("from").alias("to"), F.col("to").alias("further"))
            jumped = saved(hooks.join(further, "to").select("from", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "hooks")
            done = jumped.where("moved").isEmpty()
            hooks = jumped.select("from", "to")
            if done:
                break
        labels = saved(labels.join(hooks, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = hooks.select(F.col("from").alias("la"), F.col("to").alias("ta"))
        edges = edges.join(ends, "la").join(ends.select(F.col("la").alias("lb"), F.col("ta").alias("tb")), "lb")
        edges = saved(edges.where("ta <> tb").select(F.col("ta").alias("la"), F.col("tb").alias("lb")).distinct(), "links")
    return labels
