"""City risk reports for all cities in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise.functions.rules import city_advice
from kerbwise.operators.filters import for_city, located
from kerbwise.operators.spatial import city_top_cells
from kerbwise.operators.totals import avg_severity, marginals, ranked_value


def city_month_counts(df: DataFrame) -> DataFrame:
    return (
        located(df)
        .where(F.col("city").isNotNull() & F.col("month").isNotNull())
        .groupBy("city", "month")
        .agg(F.count("*").alias("accident_count"))
    )


def city_risk_reports(df: DataFrame, city: str | None = None) -> DataFrame:
    """One row per city: totals, peak hour, riskiest road and vehicle, months, advice, top cells.

    The fact is scanned once for the per-city marginals and once for the cells.
    What is gathered per city is bounded: twelve months and five cells.
    """
    rows = located(for_city(df, city)).where(F.col("city").isNotNull())
    by_value = marginals(rows, ["hour", "road_type", "vehicle_type", "month"], within=("city",))
    is_hour, is_month = F.col("factor") == "hour", F.col("factor") == "month"
    mean_order = F.struct(-avg_severity(), F.col("value"))

    def total(name: str) -> Column:
        return F.sum(F.when(is_hour, F.col(name)))

    def riskiest(factor: str) -> Column:
        return ranked_value(
            F.when((F.col("factor") == factor) & avg_severity().isNotNull(), F.col("value")), mean_order
        )

    months = F.sort_array(
        F.collect_list(
            F.when(
                is_month & F.col("value").isNotNull(),
                F.struct(F.col("value").cast("int").alias("month"), F.col("n").alias("n")),
            )
        )
    )
    base = (
        by_value.groupBy("city")
        .agg(
            total("n").alias("total_accidents"),
            total("fatal_n").alias("fatal_accidents"),
            F.try_divide(total("severity_sum"), total("n_severity")).alias("avg_severity"),
            total("casualties_sum").alias("total_casualties"),
            F.try_divide(total("fatalities_sum") * 100.0, total("n")).alias("fatality_rate"),
            ranked_value(
                F.when(is_hour, F.col("value").cast("int")),
                F.struct(-F.col("n"), F.col("value").cast("int")),
            ).alias("peak_accident_hour"),
            riskiest("road_type").alias("riskiest_road_type"),
            riskiest("vehicle_type").alias("riskiest_vehicle_type"),
            F.map_from_entries(months).alias("seasonal_pattern"),
        )
        .withColumn(
            "recommendations",
            city_advice(F.col("fatality_rate"), F.col("avg_severity"), F.col("peak_accident_hour")),
        )
    )
    hotspots = (
        city_top_cells(rows)
        .groupBy(F.col("city").alias("_city"))
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("position", "cell", "accident_count", "latitude", "longitude", "avg_severity")
                )
            ).alias("top_hotspots")
        )
    )
    return base.join(hotspots, F.col("city") == F.col("_city"), "left").drop("_city")
