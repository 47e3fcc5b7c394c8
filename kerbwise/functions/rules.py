"""Threshold rules: risk level and advice lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.calendar import is_rush_hour


def risk_level(risk_score: Column) -> Column:
    """LOW, MEDIUM, HIGH or CRITICAL; null for a null score."""
    out = F.when(risk_score.isNull(), F.lit(None).cast("string"))
    for bound, name in fixed.RISK_LEVEL_BOUNDS:
        out = out.when(risk_score < bound, name)
    return out.otherwise(fixed.RISK_LEVEL_TOP)


def _kept(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def trip_advice(
    level: Column, hour: Column, weather: Column, vehicle: Column, road: Column
) -> Column:
    advice = _kept(
        F.when(level.isin("HIGH", "CRITICAL"), fixed.TRIP_HIGH_RISK),
        F.when(hour.isin(fixed.TRIP_RUSH_HOURS), fixed.TRIP_RUSH),
        F.when(weather != "Clear", fixed.TRIP_WEATHER),
        F.when(vehicle.isin(fixed.VULNERABLE_VEHICLES), fixed.TRIP_VULNERABLE),
        F.when(road == "Highway", fixed.TRIP_HIGHWAY),
    )
    return F.when(F.size(advice) == 0, F.array(F.lit(fixed.TRIP_DEFAULT))).otherwise(advice)


def city_advice(fatality_rate: Column, avg_severity: Column, peak_hour: Column) -> Column:
    return _kept(
        F.when(fatality_rate > 5, fixed.CITY_FATALITY),
        F.when(avg_severity > 2.0, fixed.CITY_SEVERITY),
        F.when(is_rush_hour(peak_hour), F.format_string(fixed.CITY_RUSH, peak_hour)),
    )


def infrastructure_advice(
    avg_severity: Column, road: Column, fatalities: Column, incidents: Column
) -> Column:
    return _kept(
        F.when(avg_severity > 2, fixed.INFRA_CAMERAS),
        F.when(road == "Highway", fixed.INFRA_BARRIERS),
        F.when(fatalities > 0, fixed.INFRA_EMERGENCY),
        F.when(incidents > 10, fixed.INFRA_SIGNALS),
    )
