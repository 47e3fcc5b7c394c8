"""Road lines cut by the hexagon grid: length of road in each cell, and incidents for each kilometre of it.

A segment is a straight line of the grid's plane. All edges of the grid lie on three families of
parallel lines, at whole numbers of ``x`` and of ``x/2 + 3/4 y`` and ``x/2 - 3/4 y`` in suitable units, so the
places where a segment changes its cell are among those where one of three numbers, each linear along the segment, is
whole. Each piece between two such places lies in the cell of its middle. Everything is Column expressions; a
segment is handled by itself, and its pieces' shares add up to 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise.functions.geo import (
    GRID_BASE_RESOLUTION, Y_SCALE, edge_km, haversine_m, short_way, with_cell, x_scale,
)
from kerbwise.session import written


def _whole_between(a: Column, b: Column) -> Column:
    """Shares of the way from ``a`` to ``b`` at which the value is a whole number."""
    low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
    wholes = F.when((a != b) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(wholes, lambda m: (m - a) / (b - a))


def cut_by_cells(segments: DataFrame, resolution: int = GRID_BASE_RESOLUTION) -> DataFrame:
    """Pieces of two-point segments (``road_id, lat0, lon0, lat1, lon1``): road, cell and length in metres.

    A piece's length is its share of the segment's great-circle length. A segment without length is one piece of
    length 0; one without a position is left out.
    """
    edge, scale = edge_km(resolution), x_scale(resolution)
    length = haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    plane = segments.where(F.col("lat0").isNotNull() & F.col("lon0").isNotNull() & F.col("lat1").isNotNull() & F.col("lon1").isNotNull()).select(
        "road_id",
        length.alias("length"),
        (F.radians("lon0") * scale).alias("x0"),
        (F.radians(F.col("lon0") + short_way(F.col("lon1") - F.col("lon0"))) * scale).alias("x1"),
        (F.sin(F.radians("lat0")) * Y_SCALE).alias("y0"),
        (F.sin(F.radians("lat1")) * Y_SCALE).alias("y1"),
    )
    third = math.sqrt(3.0) / 3.0
    families = [(2.0 * third, 0.0), (third, 1.0), (third, -1.0)]

    def along(i: int, kx: float, ky: float) -> Column:
        return (F.col(f"x{i}") * kx + F.col(f"y{i}") * ky) / edge

    cuts = [_whole_between(along(0, *k), along(1, *k)) for k in families]
    places = F.array_sort(F.array_distinct(F.flatten(F.array(F.array(F.lit(0.0), F.lit(1.0)), *cuts))))
    pieces = plane.withColumn("places", F.filter(places, lambda t: (t >= 0.0) & (t <= 1.0)))
    pieces = pieces.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("places") - 1)))
    begin, end = F.element_at("places", F.col("i")), F.element_at("places", F.col("i") + 1)
    pieces = pieces.withColumns({"share": end - begin, "middle": (begin + end) / 2.0})
    x = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("middle")
    y = F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("middle")
    located = pieces.select(
        "road_id",
        (F.col("length") * F.col("share")).alias("length_m"),
        F.degrees(F.asin(y / Y_SCALE)).alias("latitude"),
        short_way(F.degrees(x / scale)).alias("longitude"),
    )
    return with_cell(located, resolution).select("road_id", "cell", "length_m")


def road_cells(segments: DataFrame, resolution: int = GRID_BASE_RESOLUTION) -> DataFrame:
    """Length of each road in each cell it passes."""
    return cut_by_cells(segments, resolution).groupBy("road_id", "cell").agg(F.sum("length_m").alias("length_m"))


def cell_road_risk(incidents: DataFrame, segments: DataFrame, resolution: int = GRID_BASE_RESOLUTION) -> DataFrame:
    """For each cell with a road: kilometres (to the millimetre) and number of roads, incidents, and incidents for each kilometre.

    Incidents are counted by cell before they meet the roads, so a crowded cell is one row of the join.
    """
    roads = written(
        road_cells(segments, resolution)
        .groupBy("cell")
        .agg(F.round(F.sum("length_m") / 1000.0, 6).alias("road_km"), F.count("*").alias("roads")),
        "road-cells",
    )
    counted = incidents.groupBy("cell").agg(F.count("cell").alias("accident_count"), F.sum("severity").alias("severity_sum"))
    counted = written(counted, "cell-counts")  # else the join's null filter computes the cell once more
    joined = roads.join(counted, "cell", "left").withColumn("accident_count", F.coalesce("accident_count", F.lit(0).cast("long")))
    return joined.select(
        "cell", "road_km", "roads", "accident_count",
        F.try_divide("severity_sum", "accident_count").alias("avg_severity"),
        F.round(F.try_divide("accident_count", "road_km"), 6).alias("accidents_per_km"),
    )
