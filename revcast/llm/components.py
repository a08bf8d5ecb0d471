"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is a group-by with map-side minimum and a join on the node; no node's neighbours are
gathered in one row, so a hub with a third of all edges is only a skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.llm.common import checkpointed, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Joins the neighbours of each node to the smallest of them (and the node itself)."""
    if small:  # each node with its smaller neighbours
        directed = edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    else:
        directed = edges.select(F.col("x").alias("u"), F.col("y").alias("v")).unionAll(edges.select(F.col("y").alias("u"), F.col("x").alias("v")))
    least = directed.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = directed.join(least, "u")
    if small:
        new = joined.select(F.col("v").alias("x"), F.col("m").alias("y")).unionAll(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    else:
        new = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("x"), F.col("m").alias("y"))
    return new.filter(F.col("x") != F.col("y")).distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, which has none itself."""
    ends = edges.select(F.col("x").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("y").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (x, y); component is the smallest node reached.

    Null ends and loops are left out. A round's edges are deleted when the next one's are written.
    """
    edges = checkpointed(edges.select("x", "y").filter(F.col("x") != F.col("y")).distinct())
    while True:
        before, edges = edges, checkpointed(_star(_star(edges, small=False), small=True))
        release(before)
        if _all_stars(edges):
            break
    roots = edges.select(F.col("y").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("x").alias("node"), F.col("y").alias("component")).unionByName(roots)
