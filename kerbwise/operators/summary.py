"""Overall figures, city tables and the insights summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.rounding import bround2
from kerbwise.functions.rules import infrastructure_advice
from kerbwise.operators.totals import SUMS, avg_severity, marginals, merged, sums, totals
from kerbwise.session import written


def global_stats(df: DataFrame) -> DataFrame:
    """One row: counts, mean severity, distinct cities and the date range."""
    base = df.groupBy("city").agg(*sums(), F.min("date").alias("first"), F.max("date").alias("last"))
    return base.agg(
        *merged(), F.count("city").alias("cities_covered"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    ).select(
        F.coalesce("n", F.lit(0)).alias("total_accidents"),
        F.coalesce("fatal_n", F.lit(0)).alias("fatal_accidents"),
        avg_severity().alias("avg_severity"),
        "cities_covered",
        F.struct(F.col("first").alias("start"), F.col("last").alias("end")).alias("date_range"),
    )


def insights_summary(df: DataFrame) -> DataFrame:
    """Total row and one row per city, largest first.

    ``cities_covered`` counts distinct cities in the total row and, by position
    in the union, distinct road types in city rows. Both halves read the same
    small (city, road_type) table, so the fact is scanned once.
    """
    return summary_of(
        df.groupBy("city", "road_type").agg(*sums(), F.min("date").alias("first"), F.max("date").alias("last"))
    )


def summary_of(base: DataFrame) -> DataFrame:
    """The summary from sums and dates of each city and road type."""
    per_city = base.groupBy("city").agg(
        *merged(), F.count("road_type").alias("road_types"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )
    label = F.when(F.col("level") == 1, "Total Analysis").otherwise(
        F.concat(F.lit("City: "), F.col("city"))
    )
    covered = F.when(F.col("level") == 1, F.col("cities")).otherwise(F.col("road_types"))
    return (
        per_city.rollup("city")
        .agg(
            *merged(), F.grouping("city").alias("level"), F.count("city").alias("cities"),
            F.max("road_types").alias("road_types"),
            F.min("first").alias("first"), F.max("last").alias("last"),
        )
        .select(
            label.alias("category"),
            F.col("n").alias("total_accidents"),
            covered.alias("cities_covered"),
            avg_severity().alias("avg_severity"),
            F.col("fatalities_sum").alias("total_fatalities"),
            F.col("casualties_sum").alias("total_casualties"),
            F.col("first").alias("analysis_start_date"),
            F.col("last").alias("analysis_end_date"),
        )
        .orderBy(F.desc("total_accidents"), "category")
    )


def cities(df: DataFrame) -> DataFrame:
    """Incidents and mean severity of each city and state, with the number of such rows.

    The totals are written, so that counting them does not read the fact again.
    """
    rows = written(totals(df, "city", "state"), "cities")
    count = rows.agg(F.count("*")).scalar()
    return rows.select(
        "city", "state", F.col("n").alias("accident_count"),
        avg_severity().alias("avg_severity"), count.alias("total_cities"),
    ).orderBy(F.desc("accident_count"), "city", "state")


def overview_kpis(df: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Headline figures of the rows; "recent" is strictly after ``as_of`` minus ``days``."""
    since = F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    base = df.groupBy("city", "state").agg(
        *sums(), F.count_if(F.col("accident_datetime") > since).alias("recent_n")
    )
    return base.agg(
        *merged((*SUMS, "recent_n")),
        F.count_distinct("city").alias("cities"),
        F.count_distinct("state").alias("states"),
    ).select(
        F.coalesce("n", F.lit(0)).alias("total_accidents"),
        F.coalesce("recent_n", F.lit(0)).alias("recent_accidents"),
        F.coalesce("fatal_n", F.lit(0)).alias("fatal_accidents"),
        F.try_divide(F.col("fatal_n") * 100.0, "n").alias("fatal_percent"),
        "cities",
        "states",
        avg_severity().alias("avg_severity"),
        F.col("casualties_sum").alias("total_casualties"),
        F.col("fatalities_sum").alias("total_fatalities"),
    )


def city_comparison(df: DataFrame, k: int | None = None) -> DataFrame:
    """City totals, mean severity to two places (half even), largest first."""
    out = (
        totals(df.where(F.col("city").isNotNull()), "city")
        .select(
            "city",
            F.col("n").alias("total_accidents"),
            bround2(avg_severity()).alias("avg_severity"),
            F.col("fatalities_sum").alias("total_fatalities"),
            F.col("casualties_sum").alias("total_casualties"),
        )
        .orderBy(F.desc("total_accidents"), "city")
    )
    return out.limit(k) if k else out


def city_stats(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of severity, and mean casualties, of each city."""
    return df.where(F.col("city").isNotNull()).groupBy("city").agg(
        F.avg("severity").alias("city_avg_severity"),
        F.stddev_samp("severity").alias("city_severity_std"),
        F.avg("casualties").alias("city_avg_casualties"),
    )


def infrastructure_recommendations(df: DataFrame, k: int = 5) -> DataFrame:
    """Busiest city and road type pairs with the measures their figures call for."""
    return (
        totals(df.where(F.col("city").isNotNull() & F.col("road_type").isNotNull()), "city", "road_type")
        .orderBy(F.desc("n"), "city", "road_type")
        .limit(k)
        .select(
            "city",
            "road_type",
            F.col("n").alias("accident_count"),
            avg_severity().alias("avg_severity"),
            F.col("fatalities_sum").alias("fatalities"),
        )
        .withColumn(
            "recommendations",
            infrastructure_advice(
                F.col("avg_severity"), F.col("road_type"), F.col("fatalities"), F.col("accident_count")
            ),
        )
    )


def insights(df: DataFrame) -> DataFrame:
    """Insight rows (title, message, priority) from one scan.

    The leading values of each factor are picked from its marginal totals; at
    most three per factor are ever gathered.
    """
    scores = (
        F.when(F.col("factor") == "city", F.col("fatal_n").cast("double"))
        .when(F.col("factor") == "vehicle_type", avg_severity())
        .otherwise(F.col("n").cast("double"))
    )
    tie = F.when(F.col("factor") == "hour", F.lpad("value", 2, "0")).otherwise(F.col("value"))
    order = Window.partitionBy("factor").orderBy(F.desc("score"), "tie")
    leaders = (
        marginals(df, ["hour", "city", "vehicle_type", "weather"])
        .where(F.col("value").isNotNull())
        .withColumns({"score": scores, "tie": tie})
        .where((F.col("factor") != "city") | (F.col("fatal_n") > 0))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= 3)
        .groupBy("factor")
        .agg(F.sort_array(F.collect_list(F.struct("position", "value", "n"))).alias("top"))
    )
    first = F.col("top")[0]
    names = F.transform("top", lambda item: item["value"])

    def insight(text: tuple[str, str, str], message: Column) -> Column:
        title, _, priority = text
        return F.struct(
            F.lit(title).alias("title"), message.alias("message"), F.lit(priority).alias("priority")
        )

    return (
        leaders.select(
            F.when(
                F.col("factor") == "hour",
                insight(
                    fixed.INSIGHT_HOUR,
                    F.format_string(fixed.INSIGHT_HOUR[1], first["value"], first["n"]),
                ),
            )
            .when(
                F.col("factor") == "city",
                insight(
                    fixed.INSIGHT_CITIES,
                    F.format_string(fixed.INSIGHT_CITIES[1], F.array_join(names, ", ")),
                ),
            )
            .when(
                F.col("factor") == "vehicle_type",
                insight(
                    fixed.INSIGHT_VEHICLES,
                    F.format_string(
                        fixed.INSIGHT_VEHICLES[1], F.array_join(F.slice(names, 1, 2), " and ")
                    ),
                ),
            )
            .when(
                F.size("top") > 1,
                insight(
                    fixed.INSIGHT_WEATHER,
                    F.format_string(fixed.INSIGHT_WEATHER[1], first["value"]),
                ),
            )
            .alias("row")
        )
        .where(F.col("row").isNotNull())
        .select("row.*")
    )
