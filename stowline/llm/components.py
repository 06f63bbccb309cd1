"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_spread, release_shuffles, write_table


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_spread(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = join_spread(down, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (u, v) of longs; root is the smallest node of the component.

    Each round's edges are a table in the shared folder. Rounds grow with the logarithm of the longest path; only a
    count and a checksum come to the driver. No edges, no rows.
    """
    now = write_table(edges.where("u <> v").select("u", "v").distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        now = write_table(_small_star(_large_star(now)), "edges")
        release_shuffles(now.sparkSession)
        if (found := _signature(now)) == seen:
            break
        seen = found
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
