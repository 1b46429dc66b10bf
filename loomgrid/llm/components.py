"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import Workspace


def components(space: Workspace, links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest one; minima are aggregated before the shuffle, so a node with
    very many neighbours costs no single task.  Every round is a written table.
    """
    edges = space.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), f"{name}-0")
    for k in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        made = space.table(small, f"{name}-{k}")
        # Done when every node has one neighbour, and that is a root.
        n, nodes = made.agg(F.count("*"), F.count_distinct("u")).first()
        inner = made.join(made.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if n == nodes and not inner:
            return made.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(made.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        edges = made
    raise RuntimeError("components did not settle")
