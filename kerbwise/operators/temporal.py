"""Hour, weekday, month and season patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwise.functions import calendar as cal
from kerbwise.operators.filters import for_city

TEMPORAL_KEYS = {"hourly": "hour", "daily": "day_of_week", "monthly": "month"}


def rush_hour_patterns(
    df: DataFrame,
    windows: cal.RushWindows = cal.SPARK_WINDOWS,
    strict_reference: bool = False,
) -> DataFrame:
    """Count and mean severity of each city and hour, with the rush-hour category."""
    hours = df.groupBy("city", "hour").agg(
        F.count("*").alias("accident_count"), F.avg("severity").alias("avg_severity")
    )
    return with_rush_hour(hours, windows, strict_reference)


def with_rush_hour(
    hours: DataFrame, windows: cal.RushWindows = cal.SPARK_WINDOWS, strict_reference: bool = False
) -> DataFrame:
    """City and hour totals with their rush-hour category."""
    category = cal.time_category(F.col("hour"), windows, strict_reference)
    return hours.withColumn("time_category", category).orderBy("city", "hour")


def seasonal_patterns(df: DataFrame) -> DataFrame:
    return with_season(
        df.groupBy("city", "month", "year").agg(
            F.count("*").alias("accident_count"), F.avg("severity").alias("avg_severity")
        )
    )


def with_season(months: DataFrame) -> DataFrame:
    """City and month totals with their season."""
    return months.withColumn("season", cal.season_or_last(F.col("month"))).orderBy("city", "year", "month")


def temporal_view(
    df: DataFrame,
    windows: cal.RushWindows = cal.WAREHOUSE_WINDOWS,
    strict_reference: bool = False,
) -> DataFrame:
    """Count and mean severity of each city, hour, weekday and month."""
    return (
        df.groupBy("city", "hour", "day_of_week", "month")
        .agg(F.count("*").alias("accident_count"), F.avg("severity").alias("avg_severity"))
        .withColumns(
            {
                "day_type": cal.day_type(F.col("day_of_week")),
                "time_category": cal.time_category(F.col("hour"), windows, strict_reference),
            }
        )
    )


def temporal_analysis(df: DataFrame, analysis_type: str = "hourly", city: str | None = None) -> DataFrame:
    if analysis_type not in TEMPORAL_KEYS:
        raise ValueError(f"analysis_type must be one of {', '.join(TEMPORAL_KEYS)}")
    key = TEMPORAL_KEYS[analysis_type]
    return (
        for_city(df, city)
        .groupBy(key)
        .agg(
            F.count("*").alias("accident_count"),
            F.avg("severity").alias("avg_severity"),
            F.sum("casualties").alias("total_casualties"),
        )
        .orderBy(key)
    )


def hourly_counts(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("hour").isNotNull())
        .groupBy("hour")
        .agg(F.count("*").alias("count"))
        .orderBy("hour")
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    """Count of each month with the date of its first day."""
    return (
        df.where(F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy("year", "month")
        .agg(F.count("*").alias("count"))
        .withColumn("date", F.make_date("year", "month", F.lit(1)))
        .orderBy("year", "month")
    )


def hourly_city_stats(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("hour", "city")
        .agg(F.count("*").alias("accident_count"), F.avg("severity").alias("avg_severity"))
        .orderBy("hour", "city")
    )


def rush_rollup(rush: DataFrame) -> DataFrame:
    """Incidents of each time category, from the city-and-hour pattern."""
    return rush.groupBy("time_category").agg(F.sum("accident_count").alias("accident_count"))


def season_rollup(seasonal: DataFrame) -> DataFrame:
    return seasonal.groupBy("season").agg(F.sum("accident_count").alias("accident_count"))


def time_features(df: DataFrame) -> DataFrame:
    """Calendar flags and the season, as the models use them."""
    return df.withColumns(
        {
            "is_weekend": cal.flag(cal.is_weekend(F.col("day_of_week"))),
            "is_rush_hour": cal.flag(cal.is_rush_hour(F.col("hour"))),
            "is_night": cal.flag(cal.is_night(F.col("hour"))),
            "season": cal.season(F.col("month")),
        }
    )
