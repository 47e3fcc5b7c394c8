"""Shared first-level aggregates.

Most analyses group by few-valued columns. They aggregate the fact once, with
map-side combining, to a small table of exact sums and derive the rest from it.
A key that holds a third of the rows reaches the shuffle as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwise.functions.geo import mean_degrees

SUMS = ("n", "n_severity", "severity_sum", "fatal_n", "casualties_sum", "fatalities_sum")


def sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.count("severity").alias("n_severity"),
        F.sum("severity").alias("severity_sum"),
        F.count_if(F.col("severity") == 3).alias("fatal_n"),
        F.sum("casualties").alias("casualties_sum"),
        F.sum("fatalities").alias("fatalities_sum"),
    ]


def totals(df: DataFrame, *keys: str) -> DataFrame:
    """Count and exact sums of each group."""
    return df.groupBy(*keys).agg(*sums())


def merged(names: tuple[str, ...] = SUMS) -> list[Column]:
    """Aggregates that add up first-level sums."""
    return [F.sum(name).alias(name) for name in names]


def avg_severity() -> Column:
    """Mean severity from sums; null severities do not count."""
    return F.try_divide(F.col("severity_sum"), F.col("n_severity"))


def marginals(df: DataFrame, columns: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """Totals of each value of each column, as (factor, value) rows, in one scan.

    The columns are first grouped together, so only distinct combinations are
    unpivoted, not fact rows.
    """
    base = totals(df, *within, *columns)
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return (
        base.select(*within, *SUMS, F.explode(pairs).alias("pair"))
        .select(*within, "pair.factor", "pair.value", *SUMS)
        .groupBy(*within, "factor", "value")
        .agg(*merged())
    )


def cell_totals(df: DataFrame) -> DataFrame:
    """Totals of each (cell, city, state); rows without a cell are left out.

    The group without a cell is dropped by its count of cells. A filter on the
    rows would be pushed below the cell expression and compute it twice.
    """
    return (
        df.groupBy("cell", "city", "state")
        .agg(
            F.count("cell").alias("accident_count"),
            F.avg("severity").alias("avg_severity"),
            F.sum("casualties").alias("total_casualties"),
            F.sum("fatalities").alias("total_fatalities"),
            F.sum("injured").alias("total_injured"),
            F.min("date").alias("earliest_accident"),
            F.max("date").alias("latest_accident"),
            F.min("accident_datetime").alias("first_datetime"),
            F.max("accident_datetime").alias("last_datetime"),
            mean_degrees(F.col("latitude")).alias("center_lat"),
            mean_degrees(F.col("longitude")).alias("center_lon"),
        )
        .where(F.col("accident_count") > 0)
    )


def ranked_value(value: Column, order: Column) -> Column:
    """Value with the smallest ``order``; null values are passed over."""
    return F.min_by(value, F.when(value.isNotNull(), order))


