"""Incident, road, report and trip-request tables derived from a star schema.

The given warehouse has no coordinates, so positions and categories are computed
from its keys. Joins carry no hints: small dimension files are broadcast by
their real size, larger ones are shuffled and AQE splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbwise import fixed
from kerbwise.functions.geo import haversine_m, with_cell
from kerbwise.schema import INCIDENT_COLUMNS


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A warehouse table. Its schema is read from the files once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def _signed_square(value: Column) -> Column:
    return F.floor(value * F.abs(value) / 10.0).cast("long")


def _between(value: Column, limits: list[tuple[int, str]], last: str) -> Column:
    out = F
    for limit, name in limits:
        out = out.when(value < limit, name)
    return out.otherwise(last)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation key -> city and state."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("state")
    )


def incidents_from_events(events: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident rows of an events table or stream, without the cell."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    joined = (
        events.join(orders, F.col("event_id") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    event_id, value, ts, day = (F.col(c) for c in ("event_id", "value", "ts", "o_orderdate"))
    nation = F.col("n_nationkey").cast("long")
    lat_e6 = 8_000_000 + 1_000_000 * nation + _signed_square((event_id * 7919) % 2001 - 1000)
    lon_e6 = 72_000_000 + 500_000 * nation + _signed_square((event_id * 104729) % 1999 - 999)
    severity = F.when(value > 150, 3).when(value > 60, 2).otherwise(1)
    vehicle_draw = (event_id * 31 + F.col("user_id")) % 100
    casualties = (F.floor("o_totalprice").cast("long") % 5).cast("int")
    roads = {
        "City Road": ["click", "view"],
        "Highway": ["error"],
        "Rural Road": ["signup"],
        "Residential": ["purchase"],
    }
    weathers = {
        "Clear": ["AUTOMOBILE", "BUILDING"],
        "Rain": ["FURNITURE"],
        "Fog": ["HOUSEHOLD"],
        "Night": ["MACHINERY"],
    }

    def named(column: str, names: dict[str, list[str]]) -> Column:
        out = F
        for name, keys in names.items():
            out = out.when(F.col(column).isin(keys), name)
        return out

    return (
        joined.withColumns({"severity": severity, "casualties": casualties})
        .withColumns(
            {
                "accident_id": F.format_string("ACC_%06d", event_id + 1),
                "latitude": lat_e6 / 1e6,
                "longitude": lon_e6 / 1e6,
                "accident_datetime": F.make_timestamp_ntz(
                    F.year(day), F.month(day), F.dayofmonth(day),
                    F.hour(ts), F.minute(ts), F.second(ts),
                ),
                "date": day.cast("date"),
                "time": F.date_format(ts, "HH:mm:ss"),
                "hour": F.hour(ts),
                "day_of_week": F.weekday(day),
                "month": F.month(day),
                "year": F.year(day),
                "severity_label": _severity_label(F.col("severity")),
                "vehicle_type": _between(
                    vehicle_draw,
                    list(zip([40, 70, 80, 90, 98], fixed.VEHICLE_TYPES)),
                    fixed.VEHICLE_TYPES[-1],
                ),
                "road_type": named("event_type", roads),
                "weather": named("c_mktsegment", weathers),
                "fatalities": F.when((value > 150) | (event_id % 10 == 0), 1).otherwise(0),
                "injured": F.greatest(
                    F.lit(0), F.col("casualties") - F.when(F.col("severity") == 3, 1).otherwise(0)
                ),
            }
        )
    )


def _severity_label(severity: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in fixed.SEVERITY_LABELS.values()]), severity - 1)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident fact with its grid cell."""
    events = table(spark, sf_dir, "events")
    return with_cell(incidents_from_events(events, spark, sf_dir).select(INCIDENT_COLUMNS))


def incident_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated reports of incidents: one per order line, so ids repeat."""
    events = table(spark, sf_dir, "events")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"
    )
    facts = incidents_from_events(events, spark, sf_dir)
    return facts.join(lines, F.col("event_id") == F.col("l_orderkey")).select(
        *INCIDENT_COLUMNS,
        F.col("l_shipdate").alias("reported_at"),
        F.col("l_linenumber").alias("report_line"),
        F.col("l_partkey").alias("report_ref"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-point road segments."""
    supplier = table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey"), F.col("n_nationkey").cast("long")
    lat0 = 8_000_000 + 1_000_000 * nation + ((key * 7919) % 1201 - 600) * 100
    lon0 = 72_000_000 + 500_000 * nation + ((key * 104729) % 1201 - 600) * 100
    return (
        supplier.join(places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumns({"lat0_e6": lat0, "lon0_e6": lon0})
        .select(
            (key + 1).alias("road_id"),
            "city",
            F.when(key % 4 == 0, "motorway")
            .when(key % 4 == 1, "primary")
            .when(key % 4 == 2, "secondary")
            .otherwise("residential")
            .alias("highway"),
            (F.col("lat0_e6") / 1e6).alias("lat0"),
            (F.col("lon0_e6") / 1e6).alias("lon0"),
            ((F.col("lat0_e6") + ((key * 31) % 201 - 100) * 200) / 1e6).alias("lat1"),
            ((F.col("lon0_e6") + ((key * 37) % 201 - 100) * 200) / 1e6).alias("lon1"),
        )
        .withColumn(
            "length_km",
            F.round(
                haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1")) / 1000.0, 3
            ),
        )
    )


def trip_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip request per customer, some with values no model has seen or out of range."""
    customer = table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("n_nationkey").cast("long")
    lat_e6 = 8_000_000 + 1_000_000 * nation + ((key * 7919) % 401 - 200) * 100
    lon_e6 = 72_000_000 + 500_000 * nation + ((key * 104729) % 401 - 200) * 100
    vehicles = F.array(*[F.lit(v) for v in [*fixed.VEHICLE_TYPES, "Tractor"]])
    road_names = F.array(*[F.lit(r) for r in [*fixed.ROAD_TYPES, "Track"]])
    return customer.join(places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("request_id"),
        "city",
        "state",
        # a negative balance marks a request with a broken latitude
        F.when(F.col("c_acctbal") < 0, lat_e6 / 1e6 + 90.0).otherwise(lat_e6 / 1e6).alias("latitude"),
        (lon_e6 / 1e6).alias("longitude"),
        (key % 25).cast("int").alias("hour"),
        F.get(vehicles, (key % 7).cast("int")).alias("vehicle_type"),
        F.get(road_names, (key % 5).cast("int")).alias("road_type"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "Rain")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "Fog")
        .when(F.col("c_mktsegment") == "MACHINERY", "Snow")
        .alias("weather"),
    )
