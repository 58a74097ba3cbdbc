"""Connected components of a sparse graph by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popstat.session import cut_lineage


def connected_components(nodes: DataFrame, links: DataFrame, node: str, left: str, right: str) -> DataFrame:
    """``node`` with ``component``: the smallest node that links reach, itself included.

    ``nodes`` holds each node once; ``links`` are undirected and may repeat. A round takes
    the smallest label of node and neighbours, then the label of the label, and is written
    to the shared folder; rounds end when none changes. Labels are joined by node, so a
    component of any size spreads over tasks.
    """
    both = links.select(F.col(left).alias("_a"), F.col(right).alias("_b"))
    both = both.unionByName(both.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    both = cut_lineage(both.where("_a != _b").distinct())
    linked = both.select(F.col("_a").alias("_n")).distinct()
    labels = cut_lineage(linked.select("_n", F.col("_n").alias("_l")))
    while True:
        seen = both.join(labels, both["_b"] == labels["_n"]).groupBy("_a").agg(F.min("_l").alias("_m"))
        lower = labels.join(seen, labels["_n"] == seen["_a"]).select("_n", F.col("_l").alias("_old"), F.least("_l", "_m").alias("_l"))
        lower = cut_lineage(lower)
        above = lower.select(F.col("_n").alias("_t"), F.col("_l").alias("_up"))
        short = lower.join(above, lower["_l"] == above["_t"]).select("_n", "_old", F.least("_l", "_up").alias("_l"))
        short = cut_lineage(short)
        labels = short.select("_n", "_l")
        if not short.where("_l < _old").limit(1).count():
            break
    named = nodes.select(F.col(node).alias("_n"))
    return named.join(labels, "_n", "left").select(F.col("_n").alias(node), F.coalesce("_l", "_n").alias("component"))
