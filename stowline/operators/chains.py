"""Containment chains by bounded self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def walk(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """start (node, ...) with ``chain``: the node and what holds it, up to ``hops`` links (node, parent), no node twice.

    A node has one link at most. Each hop is one equi-join; Spark splits a container that holds many nodes.
    """
    out = start.withColumn("chain", F.array("node"))
    step = links.select(F.col("node").alias("_at"), F.col("parent").alias("_to"))
    for _ in range(hops):
        out = out.join(step, F.element_at("chain", -1) == F.col("_at"), "left")
        onward = F.col("_to").isNotNull() & ~F.array_contains("chain", F.col("_to"))
        out = out.withColumn("chain", F.when(onward, F.concat("chain", F.array("_to"))).otherwise(F.col("chain"))).drop("_at", "_to")
    return out
