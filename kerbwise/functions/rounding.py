"""Rounding that gives the same digits on every engine."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round2(value: Column) -> Column:
    """Round half up to two places, by way of a decimal."""
    return F.round(value.cast("decimal(18,8)"), 2).cast("double")


def bround2(value: Column) -> Column:
    """Round half to even to two places, by way of a decimal."""
    return F.bround(value.cast("decimal(18,8)"), 2).cast("double")
