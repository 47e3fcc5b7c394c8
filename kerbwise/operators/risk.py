"""Risk scores, risk factors, severity breakdowns and relative lifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions import calendar as cal
from kerbwise.functions.rounding import round2
from kerbwise.operators.totals import avg_severity, marginals, totals

ROAD_KEYS = ["city", "road_type", "vehicle_type", "weather"]
RISK_FACTORS = ["vehicle_type", "road_type", "weather"]


def risk_score() -> Column:
    """Mean severity plus weighted fatalities per incident, two places.

    Null severities are left out of the mean, as AVG does.
    """
    weighted = F.col("fatalities_sum") * fixed.FATALITY_WEIGHT
    no_gaps = (F.col("severity_sum") + weighted) / F.col("n")
    with_gaps = avg_severity() + weighted / F.col("n")
    return round2(F.when(F.col("n") == F.col("n_severity"), no_gaps).otherwise(with_gaps))


def road_risk_scores(df: DataFrame, min_incidents: int = fixed.ROAD_RISK_MIN_INCIDENTS) -> DataFrame:
    return scored_roads(totals(df, *ROAD_KEYS), min_incidents)


def scored_roads(groups: DataFrame, min_incidents: int = fixed.ROAD_RISK_MIN_INCIDENTS) -> DataFrame:
    """Totals by road, vehicle and weather with enough incidents, riskiest first."""
    return (
        groups.where(F.col("n") >= min_incidents)
        .select(
            *ROAD_KEYS,
            F.col("n").alias("accident_count"),
            avg_severity().alias("avg_severity"),
            F.col("fatalities_sum").alias("total_fatalities"),
            risk_score().alias("risk_score"),
        )
        .orderBy(F.desc("risk_score"), *ROAD_KEYS)
    )


def mean_risk_by(risk: DataFrame, column: str) -> DataFrame:
    """Unweighted mean of group risk scores. Scores are whole hundredths, summed as such."""
    hundredths = F.rint(F.col("risk_score") * 100).cast("long")
    return (
        risk.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg((F.avg(hundredths) / 100.0).alias("risk_score"))
        .orderBy(F.desc("risk_score"), column)
    )


def severity_view(df: DataFrame) -> DataFrame:
    return df.groupBy("city", "state", "vehicle_type", "road_type", "weather").agg(
        F.count("*").alias("total_accidents"),
        F.count_if(F.col("severity") == 1).alias("minor_accidents"),
        F.count_if(F.col("severity") == 2).alias("serious_accidents"),
        F.count_if(F.col("severity") == 3).alias("fatal_accidents"),
        round2(F.avg("severity")).alias("avg_severity"),
        F.sum("casualties").alias("total_casualties"),
        F.sum("fatalities").alias("total_fatalities"),
    )


def risk_factors(df: DataFrame, factors: list[str] | None = None) -> DataFrame:
    """Totals of each vehicle, road and weather value in one scan, riskiest first."""
    return (
        marginals(df, factors or RISK_FACTORS)
        .select(
            "factor",
            "value",
            F.col("n").alias("accident_count"),
            avg_severity().alias("avg_severity"),
            F.col("fatalities_sum").alias("total_fatalities"),
        )
        .orderBy("factor", F.desc("avg_severity"), "value")
    )


def severity_distribution(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("severity_label").isNotNull())
        .groupBy("severity_label")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "severity_label")
    )


def vehicle_severity_pivot(df: DataFrame) -> DataFrame:
    """Vehicle by severity counts, zero where there is none."""
    labels = list(fixed.SEVERITY_LABELS.values())
    return (
        df.where(F.col("vehicle_type").isNotNull() & F.col("severity_label").isNotNull())
        .groupBy("vehicle_type")
        .agg(*[F.count_if(F.col("severity_label") == label).alias(label) for label in labels])
        .orderBy("vehicle_type")
    )


def risk_metrics(df: DataFrame, selected: Column) -> DataFrame:
    """Rates of the selected rows beside the mean of all rows, in one pass."""
    chosen = F.coalesce(selected, F.lit(False))
    n = F.count_if(chosen)
    return df.agg(
        F.try_divide(F.sum(F.when(chosen, F.col("fatalities"))) * 100.0, n).alias("fatality_rate"),
        F.avg(F.when(chosen, F.col("casualties"))).alias("avg_casualties"),
        F.avg("casualties").alias("overall_avg_casualties"),
        F.try_divide(F.count_if(chosen & (F.col("severity") >= 2)) * 100.0, n).alias(
            "high_severity_rate"
        ),
    )


def _lift(name: str, outcome: Column, exposed: Column, baseline: Column) -> Column:
    return F.struct(
        F.lit(name).alias("comparison"),
        F.count_if(exposed).alias("exposed_n"),
        F.count_if(baseline).alias("baseline_n"),
        F.try_divide(
            F.avg(F.when(exposed, outcome)), F.avg(F.when(baseline, outcome))
        ).alias("relative_risk"),
    )


def _hourly_lift() -> Column:
    peak = cal.is_rush_hour(F.col("hour"))
    return F.struct(
        F.lit("peak_hour_rate").alias("comparison"),
        F.count_if(peak).alias("exposed_n"),
        F.count_if(~peak).alias("baseline_n"),
        F.try_divide(F.count_if(peak) / 8.0, F.count_if(~peak) / 16.0).alias("relative_risk"),
    )


def _monsoon_lift() -> Column:
    wet = F.col("month").isin(fixed.SEASON_MONTHS["Monsoon"])
    return F.struct(
        F.lit("monsoon_rate").alias("comparison"),
        F.count_if(wet).alias("exposed_n"),
        F.count_if(~wet).alias("baseline_n"),
        F.try_divide(F.count_if(wet) / 4.0, F.count_if(~wet) / 8.0).alias("relative_risk"),
    )


def relative_risk(df: DataFrame) -> DataFrame:
    """Lifts of an exposed group over its baseline, all in one pass.

    Rates of time (peak hours, monsoon) are incidents per hour of day or month of
    year; the others compare a mean outcome.
    """
    severe = cal.flag(F.col("severity") >= 2)
    fatal = cal.flag(F.col("severity") == 3)
    weekend = cal.is_weekend(F.col("day_of_week"))
    night = cal.is_night(F.col("hour"))
    rows = df.agg(
        F.array(
            _hourly_lift(),
            _monsoon_lift(),
            _lift("weekend_severe", severe, weekend, ~weekend),
            _lift(
                "highway_fatal", fatal, F.col("road_type") == "Highway", F.col("road_type") == "City Road"
            ),
            _lift(
                "motorcycle_severity", F.col("severity"),
                F.col("vehicle_type") == "Motorcycle", F.col("vehicle_type") == "Car",
            ),
            _lift("night_fatal", fatal, night, ~night),
            _lift("rain_severe", severe, F.col("weather") == "Rain", F.col("weather") == "Clear"),
        ).alias("rows")
    )
    return rows.select(F.inline("rows"))
