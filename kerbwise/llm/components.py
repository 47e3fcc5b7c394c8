"""Connected components of an edge table by large-star and small-star rounds.

Every round is two aggregates and two equi-joins; no group is collected, and each round's edges
are written to the shared folder, which cuts the lineage. The rounds end at stars whose centre
is the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.session import written


def _moved(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with v replaced by the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _moved(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _moved(down)
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(moved.select("u", F.col("m").alias("v")))
        .where("u != v")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (u, v); component is its smallest node."""
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or found[0] == 0:
            break
        state = found
        edges = written(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
