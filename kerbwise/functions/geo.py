"""Points, distances and an equal-area hexagon grid, all as Column expressions.

The grid is a Lambert cylindrical equal-area projection (standard parallel 20
degrees) tiled with pointy-top hexagons in axial coordinates. A cell is one
bigint: resolution (4 bits), q (28 bits), r (28 bits), the last two shifted to
be positive. A fixed-width key keeps grouping and joining inside hash
aggregation and codegen, and its order is (resolution, q, r). Each coarser
resolution has seven times the area. At every resolution a whole number of cells goes
around the earth (the x axis is stretched to that end, by one part in 100,000 at resolution
8), so the grid closes at the 180th meridian: a cell there has one key, whichever side a point lies on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000
EARTH_RADIUS_M = 6_371_008.8
METERS_PER_DEGREE = math.radians(1.0) * EARTH_RADIUS_M

GRID_RADIUS_KM = 6371.0072
GRID_PARALLEL_COS = math.cos(math.radians(20.0))
GRID_BASE_RESOLUTION = 8
GRID_BASE_EDGE_KM = 0.5327  # 0.737 square kilometres
AXIS_BITS = 28
AXIS_SHIFT = 1 << (AXIS_BITS - 1)
AXIS_SPAN = 1 << AXIS_BITS
RING_OFFSETS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]


def edge_km(resolution: int) -> float:
    """Hexagon edge length at a resolution."""
    return GRID_BASE_EDGE_KM * math.sqrt(7.0) ** (GRID_BASE_RESOLUTION - resolution)


def cells_around(resolution: int) -> int:
    """Number of cells in a row of the grid around the earth."""
    return round(2.0 * math.pi * GRID_RADIUS_KM * GRID_PARALLEL_COS / (math.sqrt(3.0) * edge_km(resolution)))


def x_scale(resolution: int) -> float:
    """Kilometres of the grid's x axis for each radian of longitude."""
    return cells_around(resolution) * math.sqrt(3.0) * edge_km(resolution) / (2.0 * math.pi)


#: Kilometres of the grid's y axis for each unit of the sine of the latitude.
Y_SCALE = GRID_RADIUS_KM / GRID_PARALLEL_COS


def micro_degrees(degrees: Column) -> Column:
    """Whole micro-degrees. Averages over them do not depend on row order."""
    return F.rint(degrees * MICRO).cast("long")


def mean_degrees(degrees: Column) -> Column:
    """Mean coordinate of a group, from whole micro-degrees."""
    return F.avg(micro_degrees(degrees)) / MICRO


def point(lon: Column, lat: Column) -> Column:
    """Point struct, null when a coordinate is null. Zero is a coordinate."""
    return F.when(
        lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat"))
    )


def point_wkt(lon: Column, lat: Column) -> Column:
    """``POINT (lon lat)`` with six decimals."""

    def text(degrees: Column) -> Column:
        micro = F.floor(degrees * MICRO + 0.5).cast("decimal(18,0)")
        return (micro * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(18,6)").cast("string")

    return F.concat(F.lit("POINT ("), text(lon), F.lit(" "), text(lat), F.lit(")"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere.

    Differs from a distance on the WGS84 spheroid by about 0.5 % at most.
    """
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def short_way(degrees: Column) -> Column:
    """A difference of longitudes taken the short way round; within 180 it stays as it is."""
    return F.when(degrees > 180.0, degrees - 360.0).when(degrees < -180.0, degrees + 360.0).otherwise(degrees)


def pack_cell(resolution: int, q: Column, r: Column) -> Column:
    return (
        F.lit(resolution * AXIS_SPAN * AXIS_SPAN)
        + (q.cast("long") + AXIS_SHIFT) * AXIS_SPAN
        + (r.cast("long") + AXIS_SHIFT)
    )


def cell_q(cell: Column) -> Column:
    return F.shiftright(cell, AXIS_BITS).bitwiseAND(F.lit(AXIS_SPAN - 1)) - AXIS_SHIFT


def cell_r(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(AXIS_SPAN - 1)) - AXIS_SHIFT


def cell_resolution(cell: Column) -> Column:
    return F.shiftright(cell, 2 * AXIS_BITS).cast("int")


def cell_text(cell: Column) -> Column:
    """Printable cell name, ``resolution:q:r``."""
    return F.concat_ws(
        ":",
        cell_resolution(cell).cast("string"),
        cell_q(cell).cast("string"),
        cell_r(cell).cast("string"),
    )


def _turns(q: Column, r: Column, around: Column) -> Column:
    """What to add to ``q`` so that the cell's centre lies in [-180, 180) degrees."""
    twice = 2 * q + r  # the centre's x in half cells
    return F.when(twice >= around, -around).when(twice < -around, around).otherwise(F.lit(0).cast("long"))


def canonical_cell(cell: Column) -> Column:
    """The one key of a cell that is at most once around the earth from its place."""
    around = F.get(F.array(*[F.lit(cells_around(i)).cast("long") for i in range(16)]), cell_resolution(cell))
    return cell + _turns(cell_q(cell), cell_r(cell), around) * AXIS_SPAN


def with_cell(
    df: DataFrame,
    resolution: int = GRID_BASE_RESOLUTION,
    lat: str = "latitude",
    lon: str = "longitude",
    out: str = "cell",
) -> DataFrame:
    """Add the grid cell of each point; null when a coordinate is null."""
    edge = edge_km(resolution)
    west = F.when(F.col(lon) >= 180.0, F.col(lon) - 360.0).otherwise(F.col(lon))  # the meridian itself is one line
    x = F.radians(west) * x_scale(resolution)
    y = F.sin(F.radians(F.col(lat))) * Y_SCALE
    staged = (
        df.withColumn("_qf", (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / edge)
        .withColumn("_rf", y * (2.0 / 3.0) / edge)
        .withColumns(
            {
                "_q": F.floor(F.col("_qf") + 0.5),
                "_r": F.floor(F.col("_rf") + 0.5),
                "_s": F.floor(0.5 - F.col("_qf") - F.col("_rf")),
            }
        )
        .withColumns(
            {
                "_dq": F.abs(F.col("_q") - F.col("_qf")),
                "_dr": F.abs(F.col("_r") - F.col("_rf")),
                "_ds": F.abs(F.col("_s") + F.col("_qf") + F.col("_rf")),
            }
        )
    )
    q_worst = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
    r_worst = ~q_worst & (F.col("_dr") > F.col("_ds"))
    q = F.when(q_worst, -F.col("_r") - F.col("_s")).otherwise(F.col("_q"))
    r = F.when(r_worst, -F.col("_q") - F.col("_s")).otherwise(F.col("_r"))
    rounded = staged.withColumns({"_cell_q": q, "_cell_r": r})
    turned = F.col("_cell_q") + _turns(F.col("_cell_q"), F.col("_cell_r"), F.lit(cells_around(resolution)).cast("long"))
    return rounded.withColumn(out, pack_cell(resolution, turned, F.col("_cell_r"))).drop(
        "_qf", "_rf", "_q", "_r", "_s", "_dq", "_dr", "_ds", "_cell_q", "_cell_r"
    )


def cell_centre_lat(cell: Column, resolution: int = GRID_BASE_RESOLUTION) -> Column:
    """Latitude of the cell centre; NaN for a cell outside the projected plane."""
    y = cell_r(cell) * (1.5 * edge_km(resolution))
    return F.degrees(F.asin(y * (GRID_PARALLEL_COS / GRID_RADIUS_KM)))


def cell_centre_lon(cell: Column, resolution: int = GRID_BASE_RESOLUTION) -> Column:
    x = (cell_q(cell) + cell_r(cell) / 2.0) * (math.sqrt(3.0) * edge_km(resolution))
    return F.degrees(x / x_scale(resolution))


def ring_cells(cell: Column) -> Column:
    """The cell and its six neighbours, as integer offsets of the packed key; at the 180th meridian those on the other side."""
    return F.array(*[canonical_cell(cell + F.lit(dq * AXIS_SPAN + dr)) for dq, dr in RING_OFFSETS])


# --- latitude bands with longitude buckets, for distance joins ----------------


def band_of(lat: Column, step_degrees: float) -> Column:
    return F.floor((lat + 90.0) / step_degrees).cast("int")


def buckets_in_band(band: Column, step_degrees: float) -> Column:
    """Number of longitude buckets in a latitude band, at least ``step`` wide on the ground."""
    low = band * step_degrees - 90.0
    poleward = F.greatest(F.abs(low), F.abs(low + step_degrees))
    narrowing = F.cos(F.radians(F.least(F.lit(90.0), poleward)))
    return F.greatest(F.lit(1), F.floor(360.0 * narrowing / step_degrees).cast("int"))


def bucket_of(lat: Column, lon: Column, step_degrees: float) -> Column:
    """Bucket key of a point: band in the high half, longitude bucket in the low half.

    -1 without a position: a key that is never null needs no null filter before
    a join, which would compute it twice.
    """
    band = band_of(lat, step_degrees)
    count = buckets_in_band(band, step_degrees)
    slot = F.pmod(F.floor((lon + 180.0) * count / 360.0), count.cast("long"))
    return F.coalesce(F.shiftleft(band.cast("long"), 32) + slot, F.lit(-1))


def buckets_around(lat: Column, lon: Column, radius_m: Column, step_degrees: float) -> Column:
    """Every bucket key a circle can touch. Wraps at 180 degrees and covers the poles."""
    reach = radius_m / METERS_PER_DEGREE * 1.000001
    top_band = int(math.floor(180.0 / step_degrees))
    first = F.greatest(F.lit(0), band_of(lat - reach, step_degrees))
    last = F.least(F.lit(top_band), band_of(lat + reach, step_degrees))
    spread = F.sin(F.radians(reach)) / F.cos(F.radians(lat))
    half = F.when(F.abs(lat) + reach >= 90.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), spread)))
    )

    def in_band(band: Column) -> Column:
        count = buckets_in_band(band, step_degrees)
        west = F.floor((lon - half + 180.0) * count / 360.0)
        east = F.floor((lon + half + 180.0) * count / 360.0)
        slots = F.sequence(west, F.least(east, west + count - 1))
        return F.transform(
            slots, lambda s: F.shiftleft(band.cast("long"), 32) + F.pmod(s, count.cast("long"))
        )

    return F.flatten(F.transform(F.sequence(first, last), in_band))
