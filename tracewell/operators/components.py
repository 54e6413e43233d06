"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import durable


def _neighbour_minimum(directed: DataFrame) -> DataFrame:
    """For every x its smallest neighbour or itself, combined before the shuffle."""
    return directed.groupBy("x").agg(F.min("y").alias("y_min")).select(
        "x", F.least("x", "y_min").alias("m")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of x to the smallest node around x."""
    directed = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(
        edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    )
    larger = edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    return larger.join(_neighbour_minimum(directed), "x").select(F.col("y").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie x and every smaller neighbour of x to the smallest of them."""
    directed = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    minimum = _neighbour_minimum(directed)
    tied = directed.join(minimum, "x").select(F.col("y").alias("a"), F.col("m").alias("b"))
    return tied.unionAll(minimum.select(F.col("x").alias("a"), F.col("m").alias("b")))


def _simple(edges: DataFrame) -> DataFrame:
    return edges.filter("a > b").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("a", "b")).alias("h"),
        F.bit_xor(F.hash("b", "a")).alias("g"),
    ).first()
    return row["n"], row["h"], row["g"]


def star_edges(edges: DataFrame) -> DataFrame:
    """Edges (u, v) contracted to one edge from every node to its component's smallest node.

    Alternating large-star and small-star steps; the number of rounds grows with
    the logarithm of the longest path.  Each round is written to the checkpoint
    folder, so lost executors repeat one round, not all of them.
    """
    current = durable(_simple(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))))
    before = _signature(current)
    while before[0]:
        current = durable(_simple(_small_star(_simple(_large_star(current)))))
        now = _signature(current)
        if now == before:
            break
        before = now
    return current


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) for every node; the component is named by its smallest id.

    ``edges`` has columns u and v; ``nodes`` has the column id.  Nodes without
    edges are components of their own.
    """
    stars = star_edges(edges)
    return nodes.select("id").distinct().join(
        stars.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left"
    ).select("id", F.coalesce("root", "id").alias("component"))
