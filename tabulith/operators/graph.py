"""Connected components by alternating star contraction.

Plain label propagation needs as many rounds as the graph is wide.  Contracting
stars around the smallest neighbour needs a logarithmic number of rounds, uses
only ``min`` aggregates and equi-joins, and never gathers a neighbour list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def connected_components(
    edges: DataFrame, vertices: DataFrame | None = None
) -> DataFrame:
    """``(id, component)`` where the component is its smallest member.

    ``edges`` has ``src, dst``; vertices without an edge stand alone.
    """
    current = cut_lineage(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    before = None
    while True:
        current = cut_lineage(_small_star(_large_star(current)))
        state = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        now = (state["n"], state["h"])
        if now == before:
            break
        before = now
    members = current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        current.select("v", F.col("v").alias("component"))
    ).distinct()
    if vertices is None:
        return members
    return vertices.select("id").distinct().join(members, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    around = _both(edges)
    low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        around.join(low, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of a node, and itself, to the smallest of them."""
    directed = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = directed.groupBy("u").agg(F.min("v").alias("m"))
    linked = directed.join(low, "u")
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .where("u <> v").distinct()
    )
