"""Connected components with alternating large-star and small-star rounds, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v")))


def connect(edges: DataFrame, space: Workspace) -> DataFrame:
    """(node, label) of every node that has an edge (u, v) and is not the least of its component; label is that least.

    Each round is written to the shared folder, which cuts the lineage; rounds grow with the logarithm of a component's
    width. Self-loops and repeated edges are allowed.
    """
    edges = space.save(edges.where("u != v").distinct(), "edges")
    seen = None
    while True:
        turned = space.save(_small_star(_large_star(edges).distinct()).where("u != v").distinct(), "star")
        space.drop(edges)
        edges = turned
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    out.saved_path = edges.saved_path
    return out
