"""SQL surface: session views over the incident table, and table functions that search around one centre or many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.geo import EARTH_RADIUS_M, METERS_PER_DEGREE, bucket_of
from kerbwise.operators.risk import severity_view
from kerbwise.operators.spatial import hotspot_view
from kerbwise.operators.temporal import temporal_view


def register_views(spark: SparkSession, incidents: DataFrame, roads: DataFrame | None = None) -> None:
    """Create the temporary views ``accidents``, ``accident_hotspots``, ``temporal_patterns``,
    ``severity_analysis`` (and ``roads``), and two table functions of a latitude, a longitude and a radius.

    ``accidents_within_radius`` is for one centre: its box reaches the table scan. ``accidents_near`` is for the
    centres of a table, called through LATERAL. Spark turns it into a join of the distinct centres' buckets with
    ``accident_buckets``, so no centre is compared with incidents of other buckets. A centre that is null or off the
    globe finds nothing. Views are lazy: filters of a query on them reach the table scan.
    """
    incidents.createOrReplaceTempView("accidents")
    bucket = bucket_of(F.col("latitude"), F.col("longitude"), _STEP)
    incidents.withColumn("bucket", bucket).createOrReplaceTempView("accident_buckets")
    hotspot_view(incidents).createOrReplaceTempView("accident_hotspots")
    temporal_view(incidents).createOrReplaceTempView("temporal_patterns")
    severity_view(incidents).createOrReplaceTempView("severity_analysis")
    if roads is not None:
        roads.createOrReplaceTempView("roads")
    spark.sql(_RADIUS_FUNCTION)
    spark.sql(_NEAR_FUNCTION)


#: Degrees of longitude that the radius reaches at most, away from the poles.
_HALF = f"""degrees(asin(least(1.0D, sin(radians(radius_meters * 1.000001D / {METERS_PER_DEGREE}D)) / cos(radians(center_lat)))))"""

#: Distance rounded half up to two places. A decimal settles only what lies near a half; it costs some hundred times the rest.
_METERS = """CASE WHEN abs(near.meters * 100D - floor(near.meters * 100D) - 0.5D) > 0.0001D
              THEN floor(near.meters * 100D + 0.5D) / 100D
              ELSE CAST(round(CAST(near.meters AS DECIMAL(18,8)), 2) AS DOUBLE) END"""

_RADIUS_FUNCTION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION accidents_within_radius(
    center_lat DOUBLE, center_lon DOUBLE, radius_meters INT DEFAULT {fixed.RADIUS_METERS})
RETURNS TABLE(accident_id STRING, city STRING, severity INT, distance_meters DOUBLE)
RETURN
  SELECT near.accident_id, near.city, near.severity,
         {_METERS}
  FROM (
    SELECT a.accident_id, a.city, a.severity,
           2 * {EARTH_RADIUS_M} * asin(sqrt(least(1.0D,
             pow(sin(radians(a.latitude - center_lat) / 2), 2)
             + cos(radians(center_lat)) * cos(radians(a.latitude))
               * pow(sin(radians(a.longitude - center_lon) / 2), 2)))) AS meters
    FROM accidents a
    WHERE a.latitude BETWEEN center_lat - radius_meters * 1.000001D / {METERS_PER_DEGREE}D
                         AND center_lat + radius_meters * 1.000001D / {METERS_PER_DEGREE}D
      AND (abs(center_lat) + radius_meters * 1.000001D / {METERS_PER_DEGREE}D >= 90
           OR a.longitude BETWEEN center_lon - {_HALF} AND center_lon + {_HALF}
           OR a.longitude >= center_lon - {_HALF} + 360
           OR a.longitude <= center_lon + {_HALF} - 360)
  ) near
  WHERE near.meters <= radius_meters
  ORDER BY 4, 1
"""

#: Buckets are one default radius high. A larger radius touches more of them.
_STEP = fixed.RADIUS_METERS / METERS_PER_DEGREE
_REACH = f"(radius_meters / {METERS_PER_DEGREE}D * 1.000001D)"
_SIDE = f"if(abs(center_lat) + {_REACH} >= 90, 180D, {_HALF})"


def _band(lat: str) -> str:
    return f"CAST(floor(({lat} + 90) / {_STEP!r}D) AS INT)"


def _slot(lon: str) -> str:
    return f"floor(({lon} + 180) * band.slots / 360)"


#: The bands that a circle touches, each with its number of longitude buckets, and the keys of the buckets in reach.
_BUCKETS = f"""
  flatten(transform(
    transform(
      sequence(greatest(0, {_band(f"center_lat - {_REACH}")}), least({int(180 / _STEP)}, {_band(f"center_lat + {_REACH}")})),
      b -> named_struct('band', CAST(b AS BIGINT), 'slots', greatest(1L, CAST(floor(360D * cos(radians(least(90D,
        greatest(abs(b * {_STEP!r}D - 90), abs(b * {_STEP!r}D - 90 + {_STEP!r}D))))) / {_STEP!r}D) AS BIGINT)))),
    band -> transform(
      sequence({_slot(f"center_lon - {_SIDE}")},
               least({_slot(f"center_lon + {_SIDE}")}, {_slot(f"center_lon - {_SIDE}")} + band.slots - 1)),
      s -> shiftleft(band.band, 32) + pmod(s, band.slots))))"""

#: A centre is a row for each of its buckets, which the planner does not count, so neither side is broadcast: the work is
#: shared out by bucket over all tasks.
_NEAR_FUNCTION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION accidents_near(
    center_lat DOUBLE, center_lon DOUBLE, radius_meters INT DEFAULT {fixed.RADIUS_METERS})
RETURNS TABLE(accident_id STRING, city STRING, severity INT, distance_meters DOUBLE)
RETURN
  SELECT near.accident_id, near.city, near.severity,
         {_METERS}
  FROM (
    SELECT /*+ MERGE(reached) */ a.accident_id, a.city, a.severity,
           2 * {EARTH_RADIUS_M} * asin(sqrt(least(1.0D,
             pow(sin(radians(a.latitude - center_lat) / 2), 2)
             + cos(radians(center_lat)) * cos(radians(a.latitude))
               * pow(sin(radians(a.longitude - center_lon) / 2), 2)))) AS meters
    FROM (SELECT explode(if(abs(center_lat) <= 90 AND abs(center_lon) <= 180, {_BUCKETS}, array())) AS bucket) reached
    JOIN accident_buckets a ON a.bucket = reached.bucket
  ) near
  WHERE near.meters <= radius_meters
"""
