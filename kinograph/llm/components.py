"""Connected components by alternating star contractions; every step is a join and a minimum by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import Tables


def _stars(edges: DataFrame) -> bool:
    """Whether every u of the edges (u, v) has one v, and no v is a u: nothing is left to contract."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.where("below > 1 or below = 1 and above = 1").agg(F.count("*").alias("n")).first().n == 0


def connected_components(edges: DataFrame, tables: Tables, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    edges has the columns a and b (long); rows with equal ends or a null end link nothing. Large stars link every larger
    neighbour to a node's smallest neighbour, small stars every smaller one; the graph turns into stars in O(log^2) rounds,
    none if it has that form already. Each round's edges go to the shared folder. A node with very many neighbours is only
    met by sums and joins on rows of two numbers, which Spark splits.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = tables.keep(edges)
    rounds = 0
    while not _stars(edges):
        if rounds == most_rounds:
            raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
        rounds += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours larger than u go to m
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = tables.keep(small)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
