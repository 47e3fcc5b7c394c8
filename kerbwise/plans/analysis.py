"""The full batch analysis: one pass over the fact, then every result table from its shared sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.functions.geo import MICRO, micro_degrees
from kerbwise.operators.risk import ROAD_KEYS, road_risk_scores, scored_roads
from kerbwise.operators.spatial import (
    busy_squares,
    clusters_of,
    grid_hotspots,
    grid_square,
    hotspot_view,
    spatial_clusters,
)
from kerbwise.operators.summary import insights_summary, summary_of
from kerbwise.operators.temporal import rush_hour_patterns, seasonal_patterns, with_rush_hour, with_season
from kerbwise.operators.totals import SUMS, avg_severity, merged, sums
from kerbwise.session import new_path
from kerbwise.sources.results import ResultStore

#: Groupings that the result tables need of the fact.
GROUPINGS = {
    "cells": ["cell", "city", "state"],
    "hours": ["city", "hour"],
    "months": ["city", "month", "year"],
    "roads": ROAD_KEYS,
    "squares": ["city", "lat_grid", "lon_grid"],
}


def analyses(incidents: DataFrame) -> dict[str, DataFrame]:
    """Lazy result tables by name, each with a scan of its own."""
    return {
        "accident_clusters": spatial_clusters(incidents),
        "rush_hour_patterns": rush_hour_patterns(incidents),
        "seasonal_patterns": seasonal_patterns(incidents),
        "road_risk_scores": road_risk_scores(incidents),
        "grid_hotspots": grid_hotspots(incidents),
        "analysis_summary": insights_summary(incidents),
    }


def shared_sums(incidents: DataFrame) -> DataFrame:
    """Exact sums of every grouping of ``GROUPINGS`` in one scan, with the ``grouping`` each row belongs to.

    Rows are multiplied inside the task that reads them and summed there before the shuffle, so what
    travels is at most one row for each group and task, however many incidents a group has.
    """
    keys = sorted({key for columns in GROUPINGS.values() for key in columns})
    left_out = {
        sum(1 << (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in columns): name
        for name, columns in GROUPINGS.items()
    }
    which = F.element_at(F.create_map(*[F.lit(x) for pair in left_out.items() for x in pair]), F.grouping_id().cast("int"))
    rows = incidents.select(
        "*", *grid_square(), micro_degrees(F.col("latitude")).alias("lat_e6"), micro_degrees(F.col("longitude")).alias("lon_e6")
    )
    return (
        rows.groupingSets(list(GROUPINGS.values()), *keys)
        .agg(
            *sums(), F.min("date").alias("first"), F.max("date").alias("last"),
            (F.avg("lat_e6") / MICRO).alias("center_lat"), (F.avg("lon_e6") / MICRO).alias("center_lon"),
            which.alias("grouping"),
        )
    )


def tables_of(shared: DataFrame) -> dict[str, DataFrame]:
    """The tables of :func:`analyses` from a written table of :func:`shared_sums`."""

    def part(name: str) -> DataFrame:
        return shared.where(F.col("grouping") == name)

    count, severity = F.col("n").alias("accident_count"), avg_severity().alias("avg_severity")
    cells = part("cells").where(F.col("cell").isNotNull()).select(
        *GROUPINGS["cells"], count, severity, F.col("casualties_sum").alias("total_casualties"),
        F.col("fatalities_sum").alias("total_fatalities"), F.col("first").alias("earliest_accident"),
        F.col("last").alias("latest_accident"), "center_lat", "center_lon",
    )
    squares = part("squares").select(
        *GROUPINGS["squares"], "center_lat", "center_lon", F.col("n").alias("max_nearby_accidents"),
        avg_severity().alias("hotspot_severity"), F.col("fatal_n").alias("total_fatal_accidents"),
    )
    by_road = part("roads").groupBy("city", "road_type").agg(
        *merged(), F.min("first").alias("first"), F.max("last").alias("last")
    )
    return {
        "accident_clusters": clusters_of(cells),
        "rush_hour_patterns": with_rush_hour(part("hours").select(*GROUPINGS["hours"], count, severity)),
        "seasonal_patterns": with_season(part("months").select(*GROUPINGS["months"], count, severity)),
        "road_risk_scores": scored_roads(part("roads").select(*ROAD_KEYS, *SUMS)),
        "grid_hotspots": busy_squares(squares).drop("lat_grid", "lon_grid"),
        "analysis_summary": summary_of(by_road),
    }


def run_complete_analysis(incidents: DataFrame, store: ResultStore) -> dict[str, DataFrame]:
    """Run and store every analysis; returns the stored tables.

    The fact is read once. Its shared sums are written with a folder for each grouping, and a result
    table reads only the folder it is made of.
    """
    spark = incidents.sparkSession
    shared = shared_sums(incidents)
    path = new_path(spark, "shared-sums")
    shared.write.partitionBy("grouping").parquet(path)
    for name, df in tables_of(spark.read.schema(shared.schema).parquet(path)).items():
        store.save(df, name)
    return store.load_all()


def refresh_hotspot_table(incidents: DataFrame, store: ResultStore) -> DataFrame:
    """Rebuild the stored hotspot table from the fact."""
    flat = hotspot_view(incidents).withColumns(
        {"centroid_lat": F.col("centroid.lat"), "centroid_lon": F.col("centroid.lon")}
    )
    store.save(flat.drop("centroid"), "accident_hotspots")
    return store.load("accident_hotspots")
