"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _large(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least node around."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node's lower neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node with an edge; the root is the least node reachable.

    edges: (u, v) with any order, repeats and loops. Each step is written to the shared folder.
    Ends when a step changes nothing: then every node is linked to its root alone.
    """
    directed = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = store.written(directed, "edges")
    mark = _mark(now)
    while mark[0]:
        then = store.written(_small(_large(now).distinct()).distinct(), "edges")
        store.forget(now)
        was, now, mark = mark, then, _mark(then)
        if mark == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
