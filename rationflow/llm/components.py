"""Connected components of a link table, by alternating star rounds.

Each round sends every node's larger neighbours to its least neighbour, then
every node to its least neighbour of the smaller side; the trees flatten until
all nodes of a component hang on its least node.  A round is two grouped
minima (folded inside each task) and two joins; links stay in the cluster and
each round starts from a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import written


def _flat(edges: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    if not edges.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return False
    return edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links of long node ids -> (node, component), component being the least
    node; nodes without a link are not listed."""
    edges = written(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _flat(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small)
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
