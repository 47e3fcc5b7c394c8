"""Sample incidents and the city dimension.

Every draw comes from a digest of (seed, row id), so a row does not depend on
partitioning, order or retries, and any SQL engine can reproduce it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.calendar import flag
from kerbwise.schema import INCIDENT_COLUMNS

DRAW_HEX = 8  # 32 bits per draw


def draw(digest: Column, index: int) -> Column:
    """The ``index``-th uniform number in [0, 1) of a hex digest."""
    word = F.substring(digest, index * DRAW_HEX + 1, DRAW_HEX)
    return F.conv(word, 16, 10).cast("long") / float(1 << 32)


def cumulative(weights: list[float]) -> list[float]:
    """Upper bounds of all but the last category."""
    total, running, bounds = sum(weights), 0.0, []
    for weight in weights[:-1]:
        running += weight / total
        bounds.append(round(running, 12))
    return bounds


def pick(u: Column, names: list, weights: list[float]) -> Column:
    out = F
    for bound, name in zip(cumulative(weights), names):
        out = out.when(u < bound, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def poisson_bounds(mean: int) -> list[float]:
    """Cumulative Poisson probabilities up to the last one a 32-bit draw can pass."""
    bounds, term, total, k = [], math.exp(-mean), 0.0, 0
    while total + term < 1.0 - 2.0**-33:
        total += term
        bounds.append(round(total, 12))
        k += 1
        term *= mean / k
    return bounds


def poisson(u: Column, mean: Column) -> Column:
    """Inverse-CDF Poisson draw for a mean of 1, 2 or 3: how many bounds lie at or below ``u``.

    One comparison per count, with the bound looked up by the mean, keeps the
    generated code small enough to be compiled.
    """
    tables = [poisson_bounds(m) for m in (1, 2, 3)]
    longest = max(map(len, tables))
    padded = [table + [1.0] * (longest - len(table)) for table in tables]
    out = F
    for k, bounds in enumerate(zip(*padded)):
        out = out.when(u < F.get(F.array(*[F.lit(b) for b in bounds]), mean - 1), k)
    return out.otherwise(longest)


def synthesize(ids: DataFrame, id_column: str, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    """One sample incident per distinct row id (0, 1, 2, ...)."""
    row_id = F.col(id_column)
    cities = list(fixed.CITY_CENTRES)
    base = ids.select(
        row_id.alias("_id"),
        F.sha2(F.concat(F.lit(f"{seed}:a:"), row_id.cast("string")), 256).alias("_a"),
        F.sha2(F.concat(F.lit(f"{seed}:b:"), row_id.cast("string")), 256).alias("_b"),
    )
    base = base.select(
        "_id",
        *[draw(F.col("_a"), k).alias(f"_a{k}") for k in range(8)],
        *[draw(F.col("_b"), k).alias(f"_b{k}") for k in range(6)],
    )
    a = [F.col(f"_a{k}") for k in range(8)]
    b = [F.col(f"_b{k}") for k in range(6)]
    lats = [fixed.CITY_CENTRES[c][0] for c in cities]
    lons = [fixed.CITY_CENTRES[c][1] for c in cities]
    offset = fixed.SAMPLE_OFFSET_DEGREES

    def by_city(values: list) -> Column:
        """Every city is equally likely."""
        return F.get(F.array(*[F.lit(v) for v in values]), F.floor(a[0] * len(cities)).cast("int"))

    def scatter(centres: list[float], u: Column) -> Column:
        return F.round(by_city(centres) + (u * 2.0 - 1.0) * offset, 6)

    drawn = base.select(
        "_id", "_a0", "_b3", "_b4", "_b5",
        F.format_string("ACC_%06d", F.col("_id").cast("long") + 1).alias("accident_id"),
        by_city(cities).alias("city"),
        scatter(lats, a[1]).alias("latitude"),
        scatter(lons, a[2]).alias("longitude"),
        F.date_add(
            F.lit(fixed.SAMPLE_START).cast("date"), F.floor(a[3] * fixed.SAMPLE_DAYS).cast("int")
        ).alias("date"),
        pick(a[4], list(range(24)), fixed.HOUR_WEIGHTS).alias("hour"),
        F.floor(a[5] * 60).cast("int").alias("_minute"),
        F.floor(a[6] * 60).cast("int").alias("_second"),
        pick(a[7], [1, 2, 3], fixed.SEVERITY_WEIGHTS).alias("severity"),
        pick(b[0], fixed.VEHICLE_TYPES, fixed.VEHICLE_WEIGHTS).alias("vehicle_type"),
        pick(b[1], fixed.ROAD_TYPES, fixed.ROAD_WEIGHTS).alias("road_type"),
        pick(b[2], fixed.WEATHER_TYPES, fixed.WEATHER_WEIGHTS).alias("weather"),
    )
    fatal = F.col("severity") == 3
    return drawn.withColumns(
        {
            "state": by_city([fixed.CITY_STATES[c] for c in cities]),
            "accident_datetime": F.make_timestamp_ntz(
                F.year("date"), F.month("date"), F.dayofmonth("date"),
                F.col("hour"), F.col("_minute"), F.col("_second"),
            ),
            "time": F.format_string("%02d:%02d:%02d", "hour", "_minute", "_second"),
            "day_of_week": F.weekday("date"),
            "month": F.month("date"),
            "year": F.year("date"),
            "severity_label": F.element_at(
                F.array(*[F.lit(v) for v in fixed.SEVERITY_LABELS.values()]), F.col("severity")
            ),
            "casualties": poisson(b[3], F.col("severity")),
            "fatalities": flag(fatal | (b[4] < fixed.SAMPLE_MINOR_FATALITY_RATE)),
            "injured": F.greatest(F.lit(0), poisson(b[5], F.col("severity")) - flag(fatal)),
        }
    ).select(INCIDENT_COLUMNS)


def sample_incidents(spark: SparkSession, rows: int = 10_000, seed: int = fixed.SAMPLE_SEED) -> DataFrame:
    return synthesize(spark.range(rows), "id", seed)


def state_expression(city: Column) -> Column:
    out = F
    for name, state in fixed.CITY_STATES.items():
        out = out.when(city == name, state)
    return out.otherwise(fixed.UNKNOWN_STATE)


def city_states(spark: SparkSession) -> DataFrame:
    """The ten-row city dimension."""
    return spark.createDataFrame(list(fixed.CITY_STATES.items()), "city string, state string")


def with_state(df: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """State of each city; cities outside the dimension get ``Unknown``.

    Without ``dimension`` the ten fixed cities are used as an expression. A given
    dimension needs one row per city and is joined; Spark broadcasts it if its
    size allows.
    """
    plain = df.drop("state")
    if dimension is None:
        return plain.withColumn("state", state_expression(F.col("city")))
    return plain.join(dimension.select("city", "state"), "city", "left").withColumn(
        "state", F.coalesce("state", F.lit(fixed.UNKNOWN_STATE))
    )
