"""Cell clusters, hotspots, grid hotspots and neighbour density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.geo import (
    GRID_BASE_RESOLUTION,
    RING_OFFSETS,
    cell_centre_lat,
    cell_centre_lon,
    mean_degrees,
    point,
    ring_cells,
)
from kerbwise.functions.rounding import bround2
from kerbwise.operators.filters import for_city, located
from kerbwise.operators.totals import cell_totals
from kerbwise.session import written

MIN_INCIDENTS = fixed.CLUSTER_MIN_INCIDENTS


def spatial_clusters(df: DataFrame, min_incidents: int = MIN_INCIDENTS) -> DataFrame:
    """Cells with enough incidents, busiest first.

    The centroid of the collected points is the mean of their coordinates, so no
    points are collected.
    """
    return clusters_of(cell_totals(df), min_incidents)


def clusters_of(cells: DataFrame, min_incidents: int = MIN_INCIDENTS) -> DataFrame:
    """Cell totals with enough incidents, with their centroid."""
    return (
        cells.where(F.col("accident_count") >= min_incidents)
        .select(
            "cell", "city", "state", "accident_count", "avg_severity", "total_casualties",
            "total_fatalities", "earliest_accident", "latest_accident", "center_lat", "center_lon",
            point(F.col("center_lon"), F.col("center_lat")).alias("cluster_center"),
        )
        .orderBy(F.desc("accident_count"), "cell", "city", "state")
    )


def hotspot_view(df: DataFrame, min_incidents: int = MIN_INCIDENTS) -> DataFrame:
    """The hotspot table: cluster totals with injured counts and the years covered."""
    return (
        cell_totals(df)
        .where(F.col("accident_count") >= min_incidents)
        .select(
            "cell", "city", "state", "accident_count", "avg_severity", "total_casualties",
            "total_fatalities", "total_injured",
            point(F.col("center_lon"), F.col("center_lat")).alias("centroid"),
            F.year("first_datetime").alias("earliest_year"),
            F.year("last_datetime").alias("latest_year"),
        )
    )


def top_hotspots(hotspots: DataFrame, city: str | None = None, limit: int = 10) -> DataFrame:
    """Busiest hotspots with their cell centres; cells without a centre are dropped after the limit."""
    lat = cell_centre_lat(F.col("cell"), GRID_BASE_RESOLUTION)
    lon = cell_centre_lon(F.col("cell"), GRID_BASE_RESOLUTION)
    return (
        for_city(hotspots, city)
        .orderBy(F.desc("accident_count"), "cell", "city", "state")
        .limit(limit)
        .select(
            "cell", "city", "state",
            F.round(lat, 6).alias("latitude"), F.round(lon, 6).alias("longitude"),
            "accident_count", "avg_severity", "total_casualties", "total_fatalities",
        )
        .where(~F.isnan("latitude") & F.col("longitude").between(-180, 180))
    )


def cluster_preview(clusters: DataFrame, city: str | None = None, k: int = 10) -> DataFrame:
    """The busiest clusters, optionally of one city."""
    return (
        for_city(clusters, city)
        .orderBy(F.desc("accident_count"), "cell", "city", "state")
        .limit(k)
        .select("city", "accident_count", "avg_severity", "total_fatalities")
    )


def grid_hotspots(
    df: DataFrame, cells_per_degree: int = 100, min_incidents: int = fixed.GRID_MIN_INCIDENTS
) -> DataFrame:
    """Busy squares of a latitude/longitude grid."""
    squares = df.groupBy("city", *grid_square(cells_per_degree)).agg(
        mean_degrees(F.col("latitude")).alias("center_lat"),
        mean_degrees(F.col("longitude")).alias("center_lon"),
        F.count("*").alias("max_nearby_accidents"),
        F.avg("severity").alias("hotspot_severity"),
        F.count_if(F.col("severity") == 3).alias("total_fatal_accidents"),
    )
    return busy_squares(squares, min_incidents)


def grid_square(cells_per_degree: int = 100) -> list[Column]:
    """The grid square of a row."""
    return [
        F.round(F.col(c) * cells_per_degree).cast("long").alias(name)
        for c, name in (("latitude", "lat_grid"), ("longitude", "lon_grid"))
    ]


def busy_squares(squares: DataFrame, min_incidents: int = fixed.GRID_MIN_INCIDENTS) -> DataFrame:
    """Square totals with enough incidents, busiest first."""
    return (
        squares.where(F.col("max_nearby_accidents") >= min_incidents)
        .withColumn("hotspot_intensity", F.lit(1))
        .orderBy(F.desc("max_nearby_accidents"), "city", "lat_grid", "lon_grid")
        .drop("lat_grid", "lon_grid")
    )


def cell_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("cell").agg(F.count("cell").alias("n")).where(F.col("n") > 0)


def cell_density(df: DataFrame) -> DataFrame:
    """Incidents of each occupied cell, and the mean over the cell and its six neighbours.

    Each cell hands its count to the cells around it and these add up what they
    receive: one aggregate over distinct cells, no join and no per-row lookup.
    Cells without incidents of their own are dropped at the end.
    """
    received = cell_counts(df).select(
        F.explode(ring_cells(F.col("cell"))).alias("target"), "cell", "n"
    )
    own = F.col("target") == F.col("cell")
    return (
        received.groupBy(F.col("target").alias("cell"))
        .agg(
            F.max(F.when(own, F.col("n"))).alias("cell_density"),
            (F.sum("n") / len(RING_OFFSETS)).alias("neighbor_density"),
        )
        .where(F.col("cell_density").isNotNull())
    )


def cell_top(df: DataFrame, k: int = 5) -> DataFrame:
    """Busiest cells: count and mean severity to two places (half even)."""
    return (
        df.groupBy("cell")
        .agg(F.count("cell").alias("accidents"), bround2(F.avg("severity")).alias("avg_severity"))
        .where(F.col("accidents") > 0)
        .orderBy(F.desc("accidents"), "cell")
        .limit(k)
    )


def city_top_cells(df: DataFrame, k: int = 5) -> DataFrame:
    """Busiest cells within each city.

    Only cell totals enter the window, and Spark prunes to ``k`` per city before
    the shuffle, so a city with very many cells is not sorted in one task.
    """
    order = Window.partitionBy("city").orderBy(F.desc("accident_count"), "cell")
    return (
        located(df)
        .where(F.col("city").isNotNull())
        .groupBy("city", "cell")
        .agg(
            F.count("cell").alias("accident_count"),
            mean_degrees(F.col("latitude")).alias("latitude"),
            mean_degrees(F.col("longitude")).alias("longitude"),
            F.avg("severity").alias("avg_severity"),
        )
        .where(F.col("accident_count") > 0)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= k)
    )


def cell_profile(df: DataFrame, quantile: float = fixed.HOTSPOT_QUANTILE) -> DataFrame:
    """One row per cell for the hotspot model.

    Modes take the smallest value on a tie. Their buffers hold one counter per
    distinct hour or category and are combined map-side. The table of cells is
    written, so the fact is read once. The quantile is taken over a histogram of
    the counts, which has few distinct values however many cells there are; both
    scalars are subqueries, not joins.
    """
    cells = written(
        df.groupBy("cell")
        .agg(
            F.count("cell").alias("accident_count"),
            F.avg("severity").alias("avg_severity"),
            F.sum("fatalities").alias("total_fatalities"),
            F.sum("casualties").alias("total_casualties"),
            F.mode("hour", True).alias("common_hour"),
            F.mode("vehicle_type", True).alias("common_vehicle"),
            F.mode("road_type", True).alias("common_road"),
            mean_degrees(F.col("latitude")).alias("center_lat"),
            mean_degrees(F.col("longitude")).alias("center_lon"),
        )
        .where(F.col("accident_count") > 0),
        "cells",
    )
    histogram = cells.groupBy("accident_count").agg(F.count("*").alias("cells"))
    threshold = histogram.agg(F.percentile("accident_count", quantile, F.col("cells"))).scalar()
    busiest = cells.agg(F.max("accident_count")).scalar()
    return cells.withColumns(
        {
            "is_hotspot": F.when(F.col("accident_count") >= threshold, 1).otherwise(0),
            "density_score": F.col("accident_count") / busiest,
            "severity_risk": F.col("avg_severity") * F.col("total_fatalities"),
        }
    )
