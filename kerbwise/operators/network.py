"""Road network: a graph of roads, distances along it within a reach, and risk spread over it.

End points of roads are snapped to a lattice, whose points are the nodes. Distances grow in rounds: each round joins the
nodes reached or improved in the last one with the roads that leave them, keeps the shortest way to each
(source, node) within the reach, and ends when none got shorter. The table of distances has a row for each node
within reach of a source: it grows with the network, not with the incidents, which are
summed by road before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise.functions.geo import METERS_PER_DEGREE, haversine_m
from kerbwise.operators.radius import match_roads
from kerbwise.session import written


def node_of(lat: Column, lon: Column, snap_m: float) -> Column:
    """The lattice point nearest to a position, about ``snap_m`` apart from the next one (less towards the poles in longitude).

    The lattice closes at the 180th meridian.
    """
    around = max(1, round(360.0 * METERS_PER_DEGREE / snap_m))
    step = 360.0 / around
    column = F.pmod(F.floor((lon + 180.0) / step + 0.5), F.lit(around))
    return F.shiftleft(F.floor((lat + 90.0) / step + 0.5), 32) + column


def road_graph(segments: DataFrame, snap_m: float) -> DataFrame:
    """Each road with its end nodes ``u`` and ``v`` and its length; roads without a position are left out."""
    return segments.select(
        "road_id",
        node_of(F.col("lat0"), F.col("lon0"), snap_m).alias("u"),
        node_of(F.col("lat1"), F.col("lon1"), snap_m).alias("v"),
        haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")).alias("length_m"),
    ).where(F.col("u").isNotNull() & F.col("v").isNotNull())


def adjacency(graph: DataFrame) -> DataFrame:
    """Both directions of every road that joins two nodes, the shortest where several do."""
    ways = graph.where("u != v")
    back = ways.select(F.col("v").alias("u"), F.col("u").alias("v"), "length_m")
    return ways.select("u", "v", "length_m").unionByName(back).groupBy("u", "v").agg(F.min("length_m").alias("length_m"))


def distances(ways: DataFrame, sources: DataFrame, reach_m: float) -> DataFrame:
    """``(source, node, distance_m)`` for every node within ``reach_m`` of a source along ``ways`` (written tables).

    ``sources`` has a column ``node``. A way of no length cannot improve a distance, so the rounds end.
    """
    known = written(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance_m")).distinct(), "reached")
    fresh = known
    ways = written(ways.where(F.col("length_m") <= reach_m).select("u", "v", "length_m"), "ways")
    while True:
        further = (
            fresh.join(ways, F.col("node") == F.col("u"))
            .select("source", F.col("v").alias("node"), (F.col("distance_m") + F.col("length_m")).alias("distance_m"))
            .where(F.col("distance_m") <= reach_m)
            .groupBy("source", "node")
            .agg(F.min("distance_m").alias("distance_m"))
        )
        before = known.select("source", "node", F.col("distance_m").alias("before"))
        fresh = written(
            further.join(before, ["source", "node"], "left")
            .where(F.col("before").isNull() | (F.col("distance_m") < F.col("before")))
            .drop("before"),
            "shorter",
        )
        if fresh.isEmpty():
            return known
        known = written(known.unionByName(fresh).groupBy("source", "node").agg(F.min("distance_m").alias("distance_m")), "reached")


def network_risk(
    incidents: DataFrame, segments: DataFrame, snap_m: float, reach_m: float, match_m: float = 500.0
) -> DataFrame:
    """Risk of each road from the incidents on it and on the roads around it.

    The severity of the incidents matched to a road is its weight; each of its ends holds half of it. A node receives from
    every node within reach its weight, less the share of the reach that lies between them. A road's
    ``network_risk`` is the mean of what its ends receive.
    """
    graph = written(road_graph(segments, snap_m), "road-graph")
    matched = match_roads(incidents, segments, match_m, carry=("severity",))
    by_road = matched.groupBy("road_id").agg(F.count("*").alias("accident_count"), F.sum("severity").alias("weight"))
    roads = written(
        graph.join(by_road, "road_id", "left").na.fill(0, ["accident_count", "weight"]), "weighted-roads"
    )
    ends = F.explode(F.array("u", "v")).alias("node")
    weights = written(
        roads.where("weight > 0").select(ends, (F.col("weight") / 2.0).alias("weight")).groupBy("node").agg(F.sum("weight").alias("weight")),
        "node-weights",
    )
    near = distances(adjacency(graph), weights, reach_m)
    received = written(
        near.join(weights.withColumnRenamed("node", "source"), "source")
        .groupBy("node")
        .agg(F.sum(F.col("weight") * (1.0 - F.col("distance_m") / reach_m)).alias("received"), F.count("*").alias("sources")),
        "received",
    )
    halves = roads.select("road_id", "accident_count", "weight", ends).join(received, "node", "left")
    return halves.groupBy("road_id", "accident_count", "weight").agg(
        (F.sum(F.coalesce("received", F.lit(0.0))) / 2.0).alias("network_risk"),
        F.max(F.coalesce("sources", F.lit(0).cast("long"))).alias("nodes_in_reach"),
    )
