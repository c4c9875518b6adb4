"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlake.llm.common import checkpoint, join_counted


def components(links: DataFrame) -> DataFrame:
    """(u, v) -> (node, component): each linked node with the smallest node that it reaches.

    A node's neighbours are never collected: a step takes a minimum over them, with partial
    aggregation, and joins it back; nodes with very many neighbours get theirs by broadcast. Each
    step is written to the shared folder. Nulls and loops link nothing; repeated links count once.
    """
    edges = checkpoint(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    size = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = checkpoint(join_counted(both, low, "u", "n").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, low, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, edges = edges, checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        then, size = size, edges.count()
        if size == then and not edges.join(before, ["u", "v"], "left_anti").limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
