"""Connected components of a graph given as edges, in rounds of grouping and joining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortscope.llm.base import written
from cohortscope.operators.skew import join_aggregated


def _towards_minimum(edges: DataFrame, lower: bool) -> DataFrame:
    """One half round: link each node's neighbours to the smallest node near it.

    Large star (``lower`` false) re-links the neighbours above a node, small star those below it.
    The minimum is aggregated before the shuffle and joined back so that a node with very many
    neighbours can be split over tasks.
    """
    if lower:
        pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    smallest = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = join_aggregated(pairs, smallest, ["u"])
    if lower:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            smallest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    else:
        linked = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.filter("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node that an edge (a, b) touches.

    Alternates large and small stars until nothing moves, which takes about the logarithm of the
    longest chain in rounds. Each round is a table in the shared folder. Repeated edges and loops
    don't matter; without edges the result is empty.
    """
    links = written(edges.select("a", "b").filter("a <> b").distinct(), "links")
    previous = None
    for _ in range(max_rounds):
        links = written(_towards_minimum(_towards_minimum(links, False), True), "links")
        state = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
