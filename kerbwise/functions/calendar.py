"""Hour, weekday and month categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbwise import fixed


@dataclass(frozen=True)
class RushWindows:
    """Inclusive hour ranges. A range whose end is before its start wraps past midnight."""

    morning: tuple[int, int]
    evening: tuple[int, int]
    night: tuple[int, int]


SPARK_WINDOWS = RushWindows(**fixed.SPARK_HOURS)
WAREHOUSE_WINDOWS = RushWindows(**fixed.WAREHOUSE_HOURS)


def in_hours(hour: Column, window: tuple[int, int]) -> Column:
    start, end = window
    if start <= end:
        return hour.between(start, end)
    return (hour >= start) | (hour <= end)


def time_category(
    hour: Column, windows: RushWindows = SPARK_WINDOWS, strict_reference: bool = False
) -> Column:
    """Rush-hour category. ``strict_reference`` takes the night range literally, so it never matches."""
    night = F.lit(False) if strict_reference else in_hours(hour, windows.night)
    return (
        F.when(in_hours(hour, windows.morning), "Morning Rush")
        .when(in_hours(hour, windows.evening), "Evening Rush")
        .when(night, "Night")
        .otherwise("Regular Hours")
    )


def season(month: Column) -> Column:
    """Season of a month; months outside 1-12 (and nulls) have none."""
    names = {m: name for name, months in fixed.SEASON_MONTHS.items() for m in months}
    return F.get(F.array(*[F.lit(names[m]) for m in range(1, 13)]), month - 1)


def season_or_last(month: Column) -> Column:
    """Season where anything not listed counts as the last one."""
    return F.coalesce(season(month), F.lit(list(fixed.SEASON_MONTHS)[-1]))


def is_weekend(day_of_week: Column) -> Column:
    return day_of_week.isin(fixed.WEEKEND_DAYS)


def day_type(day_of_week: Column) -> Column:
    return F.when(is_weekend(day_of_week), "Weekend").otherwise("Weekday")


def is_rush_hour(hour: Column) -> Column:
    return in_hours(hour, SPARK_WINDOWS.morning) | in_hours(hour, SPARK_WINDOWS.evening)


def is_night(hour: Column) -> Column:
    """Before 6 or after 22; 22 itself is not night."""
    return (hour < 6) | (hour > 22)


def flag(condition: Column) -> Column:
    """1 where true, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)
