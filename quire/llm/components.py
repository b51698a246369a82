"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, settle


#: Edges in a file of an iteration's table, at least; small tables are written by few tasks.
EACH = 50_000


def unfinished(edges: DataFrame) -> bool:
    """Whether some node has two edges up, or one up and one down: stars with their least node as the centre have neither."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").take(1))


def least_of(neighbours: DataFrame, files: int) -> DataFrame:
    """a, m: the least b of each a, as a table."""
    return settle(neighbours.groupBy("a").agg(F.min("b").alias("m")).coalesce(files), "least")


def large_star(edges: DataFrame, files: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours. A table."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = least_of(both, files)
    tied = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
    out = settle(tied.coalesce(files), "edges")
    forget(least)
    return out


def small_star(edges: DataFrame, files: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the least of them. A table."""
    least = least_of(edges, files)
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    out = settle(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct().coalesce(files), "edges")
    forget(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """a, root: for each node of edges (columns a and b, longs, a > b) that is not the least of its component, that least node.

    The number of edges is all that comes to the driver. Joins are between written tables, so that adaptive
    execution may split a node with very many neighbours.
    """
    edges = settle(edges.filter("a <> b").distinct(), "edges")
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while unfinished(edges):
        files = min(partitions, 1 + 2 * edges.count() // EACH)
        large = large_star(edges, files)
        small = small_star(large, files)
        forget(edges)
        forget(large)
        edges = small
    return edges.select("a", F.col("b").alias("root"))
