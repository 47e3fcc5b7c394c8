"""Row filters, option lists and bounded samples."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_CITIES = "All Cities"
MODEL_COLUMNS = [
    "accident_id", "city", "state", "latitude", "longitude", "hour", "day_of_week", "month",
    "year", "severity", "vehicle_type", "road_type", "weather", "casualties", "fatalities",
    "injured", "cell",
]


def located(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def model_base(df: DataFrame) -> DataFrame:
    """Projection and null filter the models start from; clock fields come from the timestamp."""
    return (
        located(df)
        .where(F.col("severity").isNotNull())
        .withColumns(
            {
                "hour": F.hour("accident_datetime"),
                "day_of_week": F.weekday("accident_datetime"),
                "month": F.month("accident_datetime"),
                "year": F.year("accident_datetime"),
            }
        )
        .select(MODEL_COLUMNS)
    )


def newest_first(df: DataFrame) -> DataFrame:
    """Located rows, newest first. The id in the sort key also splits a hot timestamp."""
    return located(df).orderBy(F.desc("accident_datetime"), "accident_id")


def for_city(df: DataFrame, city: str | None) -> DataFrame:
    return df if city in (None, ALL_CITIES) else df.where(F.col("city") == F.lit(city))


def filter_incidents(
    df: DataFrame,
    city: str | None = None,
    date_range: tuple[dt.date, dt.date] | None = None,
    severities: Sequence[str] = (),
    vehicles: Sequence[str] = (),
) -> DataFrame:
    """City, inclusive dates and value lists; an empty list or None filters nothing."""
    out = for_city(df, city)
    if date_range:
        out = out.where(F.col("date").between(F.lit(date_range[0]), F.lit(date_range[1])))
    if severities:
        out = out.where(F.col("severity_label").isin(list(severities)))
    if vehicles:
        out = out.where(F.col("vehicle_type").isin(list(vehicles)))
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def filter_options(df: DataFrame) -> DataFrame:
    """Choices of each filter as (option, value) rows, and the first and last date, in one scan."""
    base = df.groupBy("city", "severity_label", "vehicle_type").agg(
        F.min("date").alias("first"), F.max("date").alias("last")
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("option"), F.col(name).cast("string").alias("value"))
            for name in ("city", "severity_label", "vehicle_type")
        ],
        F.struct(F.lit("min_date").alias("option"), F.col("first").cast("string").alias("value")),
        F.struct(F.lit("max_date").alias("option"), F.col("last").cast("string").alias("value")),
    )
    is_date = F.col("option").isin("min_date", "max_date")
    return (
        base.select(F.explode(pairs).alias("p"))
        .select("p.option", "p.value")
        .where(F.col("value").isNotNull())
        .groupBy("option", F.when(~is_date, F.col("value")).alias("choice"))
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .select(
            "option",
            F.when(F.col("option") == "max_date", F.col("high")).otherwise(F.col("low")).alias("value"),
        )
        .orderBy("option", "value")
    )


def sample_rows(df: DataFrame, rows: int, key: str = "accident_id") -> DataFrame:
    """A repeatable random sample of at most ``rows`` rows: the smallest key digests.

    Planned as a bounded top-k per task, not as a global sort.
    """
    return df.orderBy(F.md5(F.col(key).cast("binary")), key).limit(rows)


def heatmap_points(df: DataFrame, city: str | None = None, *, rows: int) -> DataFrame:
    """At most ``rows`` sampled [latitude, longitude, weight] points."""
    return sample_rows(located(for_city(df, city)), rows).select(
        "accident_id", F.array("latitude", "longitude", F.col("severity").cast("double")).alias("point")
    )
