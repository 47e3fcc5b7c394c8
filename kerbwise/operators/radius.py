"""Distance search, many-centre distance join, and matching incidents to roads."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions.geo import (
    EARTH_RADIUS_M,
    METERS_PER_DEGREE,
    bucket_of,
    buckets_around,
    haversine_m,
    short_way,
)
from kerbwise.functions.rounding import round2
from kerbwise.operators.risk import risk_score
from kerbwise.operators.totals import SUMS, avg_severity, merged, sums
from kerbwise.session import written


def _box(lat: float, lon: float, radius_m: float) -> Column:
    """Rows that can lie within the radius: plain comparisons that reach the file scan."""
    reach = radius_m / METERS_PER_DEGREE * 1.000001
    rows = F.col("latitude").between(lat - reach, lat + reach)
    if abs(lat) + reach >= 90.0:
        return rows
    half = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(lat)))))
    west, east = lon - half, lon + half
    inside = F.col("longitude").between(west, east)
    if west < -180.0:
        inside = inside | (F.col("longitude") >= west + 360.0)
    if east > 180.0:
        inside = inside | (F.col("longitude") <= east - 360.0)
    return rows & inside


def within_radius(
    df: DataFrame, center_lat: float, center_lon: float, radius_m: float = fixed.RADIUS_METERS
) -> DataFrame:
    """Incidents at most ``radius_m`` from a point, nearest first."""
    distance = haversine_m(F.lit(center_lat), F.lit(center_lon), F.col("latitude"), F.col("longitude"))
    return (
        df.where(_box(center_lat, center_lon, radius_m))
        .withColumn("_distance", distance)
        .where(F.col("_distance") <= radius_m)
        .select("accident_id", "city", "severity", round2(F.col("_distance")).alias("distance_meters"))
        .orderBy("distance_meters", "accident_id")
    )


#: Ids of a place that one row holds, on average.
PLACE_IDS = 1000


def places_of(rows: DataFrame, key: str) -> DataFrame:
    """The places (``latitude``, ``longitude``) of rows with the keys found there as ``ids`` (written).

    A place with many rows gets several, so no list of ids grows with the rows. Rows are numbered in written form, so a
    task that runs again deals them alike.
    """
    at = ["latitude", "longitude"]
    numbered = written(rows.withColumn("_number", F.monotonically_increasing_id()), "numbered")
    sizes = written(numbered.groupBy(at).agg(F.ceil(F.count("*") / PLACE_IDS).alias("_lists")), "place-sizes")
    same = [numbered[c].eqNullSafe(sizes[c]) for c in at]
    dealt = numbered.join(sizes, same).select(key, *[numbered[c] for c in at], F.pmod("_number", "_lists").alias("_list"))
    return written(dealt.groupBy(*at, "_list").agg(F.collect_list(F.struct(key)).alias("_ids")).select(*at, F.col("_ids")[key].alias("ids")), "places")


def radius_join(
    points: DataFrame,
    centers: DataFrame,
    radius_m: float,
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Pairs of ``points`` and ``centers`` at most ``radius_m`` apart, with ``distance_m``.

    ``centers`` has ``center_lat`` and ``center_lon`` beside its other columns.
    Both sides get buckets at least one radius wide; only the centres are
    repeated (about nine buckets each), so this is an equi-join. Centres are
    written first: if they are small they are broadcast and the points are not
    shuffled at all, otherwise AQE splits a bucket that holds many points.
    """
    step = radius_m / METERS_PER_DEGREE
    spread = written(
        centers.dropna(subset=["center_lat", "center_lon"]).withColumn(  # without a place: in reach of no bucket
            "_bucket",
            F.explode(buckets_around(F.col("center_lat"), F.col("center_lon"), F.lit(radius_m), step)),
        ),
        "centers",
    )
    near = points.withColumn("_bucket", bucket_of(F.col(lat), F.col(lon), step))
    distance = haversine_m(F.col("center_lat"), F.col("center_lon"), F.col(lat), F.col(lon))
    return (
        near.join(spread, "_bucket")
        .withColumn("distance_m", distance)
        .where(F.col("distance_m") <= radius_m)
        .drop("_bucket")
    )


#: Squares of the next level along each side of a square, most levels, and incidents of a square that need no further level.
SPLIT_BITS, MAX_LEVELS, SQUARE_ROWS = 2, 6, 16
#: Metres by which bounds must clear the radius; covers rounding in distances.
SLACK_M = 0.5

_SQUARE = ["_bucket", "_row", "_col"]
_CENTER = ["center_lat", "center_lon"]
_AROUND = SUMS[:4]  # without casualties and fatalities


def _levels(df: DataFrame, radius_m: float) -> tuple[DataFrame, list[DataFrame]]:
    """The incidents with their square, and the totals of the squares of each level, widest first.

    A bucket is split into squares, each of these into sixteen and so on, until squares hold few incidents on average.
    """
    step = radius_m / METERS_PER_DEGREE
    located = df.select("latitude", "longitude", "severity", bucket_of(F.col("latitude"), F.col("longitude"), step).alias("_bucket"))
    located = written(located.where(F.col("_bucket") >= 0), "located")

    def at(level: int) -> list[Column]:
        size = step / (1 << SPLIT_BITS * level)
        return [F.floor((F.col(c) + edge) / size).alias(name) for c, edge, name in (("latitude", 90.0, "_row"), ("longitude", 180.0, "_col"))]

    sizes = located.agg(
        F.count("*"), *[F.approx_count_distinct(F.xxhash64("_bucket", *at(level))) for level in range(1, MAX_LEVELS + 1)]
    ).first()
    levels = next((k for k in range(1, MAX_LEVELS + 1) if sizes[0] <= SQUARE_ROWS * sizes[k]), MAX_LEVELS)
    rows = written(located.select("*", *at(levels)), "squared")
    bounds = [("latitude", "low_lat", "high_lat"), ("longitude", "low_lon", "high_lon")]
    squares = [written(
        rows.groupBy(_SQUARE).agg(
            *sums()[: len(_AROUND)],
            *[c for of, low, high in bounds for c in (F.min(of).alias(low), F.max(of).alias(high))],
        ),
        "squares",
    )]
    for _ in range(levels - 1):
        squares.insert(0, written(
            squares[0].groupBy("_bucket", *[F.shiftright(c, SPLIT_BITS).alias(c) for c in ("_row", "_col")]).agg(
                *merged(_AROUND), *[f(c).alias(c) for _, low, high in bounds for f, c in ((F.min, low), (F.max, high))]
            ),
            "squares",
        ))
    return rows, squares


def _reach() -> tuple[Column, Column]:
    """Least and most distance from a centre to the incidents of a square, by the box around them.

    A place off the globe has no bounds, so it is always compared by itself.
    """
    lat, lon = ((F.col(f"low_{c}") + F.col(f"high_{c}")) / 2.0 for c in ("lat", "lon"))
    tall, wide = ((F.col(f"high_{c}") - F.col(f"low_{c}")) / 2.0 for c in ("lat", "lon"))
    up = F.abs(lat - F.col("center_lat"))
    along = F.abs(F.pmod(lon - F.col("center_lon") + 180.0, F.lit(360.0)) - 180.0)
    low = _arc(F.greatest(F.lit(0.0), up - tall), F.greatest(F.lit(0.0), along - wide), F.abs(lat) + tall)
    high = _arc(up + tall, F.least(F.lit(180.0), along + wide), F.greatest(F.lit(0.0), F.abs(lat) - tall))
    bounded = (F.abs("center_lat") <= 90.0) & (F.abs(lat) + tall <= 90.0) & (F.abs(lon) + wide <= 360.0) & (F.abs("center_lon") <= 360.0)
    return F.when(bounded, low).otherwise(F.lit(0.0)), F.when(bounded, high).otherwise(F.lit(float("inf")))


def _arc(up: Column, along: Column, lat: Column) -> Column:
    """Distance from a centre over differences of latitude and longitude, with the cosine of ``lat`` at the other end."""
    half_up, half_along = F.sin(F.radians(up) / 2.0), F.sin(F.radians(along) / 2.0)
    chord = half_up * half_up + F.cos(F.radians("center_lat")) * F.cos(F.radians(lat)) * half_along * half_along
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def _further(frontier: DataFrame, squares: DataFrame) -> DataFrame:
    """Pairs of centres and the squares of a level inside their squares of the level above."""
    parts = squares.withColumnsRenamed({"_row": "_part_row", "_col": "_part_col"})
    up = [F.shiftright(f"_part{c}", SPLIT_BITS).alias(c) for c in ("_row", "_col")]
    return frontier.join(parts.select("*", *up), _SQUARE).drop("_row", "_col").withColumnsRenamed({"_part_row": "_row", "_part_col": "_col"})


def _totals_within(spread: DataFrame, rows: DataFrame, squares: list[DataFrame], radius_m: float) -> DataFrame:
    """Sums of the incidents at most ``radius_m`` from each centre.

    Squares that lie inside the circle are added whole; only those that its edge may cross are split, and at the last level
    only their incidents are compared.
    """
    low, high = _reach()
    pairs, found = spread.join(squares[0], "_bucket"), []
    for level in range(1, len(squares) + 1):
        found.append(pairs.where(high <= radius_m - SLACK_M).groupBy(_CENTER).agg(*merged(_AROUND)))
        crossed = pairs.where((high > radius_m - SLACK_M) & (low <= radius_m + SLACK_M)).select(*_CENTER, *_SQUARE)
        if level < len(squares):
            pairs = _further(written(crossed, "crossed"), squares[level])
    meters = haversine_m(F.col("center_lat"), F.col("center_lon"), F.col("latitude"), F.col("longitude"))
    found.append(crossed.join(rows, _SQUARE).where(meters <= radius_m).groupBy(_CENTER).agg(*sums()[: len(_AROUND)]))
    return reduce(DataFrame.unionByName, found).groupBy(_CENTER).agg(*merged(_AROUND))


def _nearest_within(spread: DataFrame, rows: DataFrame, squares: list[DataFrame], radius_m: float) -> DataFrame:
    """Distance of the nearest incident at most ``radius_m`` from each centre: only squares that may hold it are split."""
    low, high = _reach()
    pairs = spread.join(squares[0], "_bucket")
    for level in range(1, len(squares) + 1):
        best = F.min("_high").over(Window.partitionBy(_CENTER))
        near = pairs.select(*_CENTER, *_SQUARE, low.alias("_low"), high.alias("_high")).where(F.col("_low") <= radius_m + SLACK_M)
        near = near.withColumn("_best", best).where(F.col("_low") <= F.col("_best") + 2.0 * SLACK_M).select(*_CENTER, *_SQUARE)
        near = written(near, "nearest-squares")
        if level < len(squares):
            pairs = _further(near, squares[level])
    meters = haversine_m(F.col("center_lat"), F.col("center_lon"), F.col("latitude"), F.col("longitude"))
    found = near.join(rows.drop("severity"), _SQUARE).withColumn("distance_m", meters).where(F.col("distance_m") <= radius_m)
    return found.groupBy(_CENTER).agg(F.min("distance_m").alias("nearest"))


def incidents_around(df: DataFrame, centers: DataFrame, key: str, radius_m: float) -> DataFrame:
    """Figures of the incidents around each centre that has any.

    Sums and the least distance are all it needs, so no pairs of centres and incidents are made but along the edge of a circle.
    Centres at one place are searched for once.
    """
    rows, squares = _levels(df, radius_m)
    placed = written(centers.select(key, *_CENTER), "places")
    step = radius_m / METERS_PER_DEGREE
    buckets = buckets_around(F.col("center_lat"), F.col("center_lon"), F.lit(radius_m), step)
    spread = written(placed.select(_CENTER).dropna().distinct().withColumn("_bucket", F.explode(buckets)), "centers")
    return (
        placed.join(_totals_within(spread, rows, squares, radius_m), _CENTER)
        .join(_nearest_within(spread, rows, squares, radius_m), _CENTER)
        .groupBy(key)
        .agg(*merged(_AROUND), F.min("nearest").alias("nearest"))
        .select(
            key,
            F.col("n").alias("accident_count"),
            avg_severity().alias("avg_severity"),
            F.col("fatal_n").alias("fatal_accidents"),
            round2(F.col("nearest")).alias("nearest_meters"),
        )
    )


def hotspots_near(
    requests: DataFrame, hotspots: DataFrame, radius_km: float = fixed.REQUEST_RADIUS_KM
) -> DataFrame:
    """Hotspots around each request: cell totals are joined, not incidents.

    The number of cells in a circle bounds the hotspots of a request (about 107
    cells per city in five kilometres), so the result grows with the requests.
    """
    centers = requests.select(
        "request_id", F.col("latitude").alias("center_lat"), F.col("longitude").alias("center_lon")
    ).where(F.col("center_lat").between(-90, 90) & F.col("center_lon").between(-180, 180))
    spots = hotspots.select(
        "cell", "city", "accident_count", "avg_severity",
        F.col("centroid.lat").alias("latitude"), F.col("centroid.lon").alias("longitude"),
    )
    return radius_join(spots, centers, radius_km * 1000.0).select(
        "request_id", "cell", "city", "accident_count", "avg_severity",
        round2(F.col("distance_m")).alias("distance_meters"),
    )


def _flattened(roads: DataFrame) -> DataFrame:
    """Each segment in metres, in a plane that touches the earth at its middle latitude.

    All that depends on the segment alone is computed here, once per road, so the
    expression that is evaluated for every candidate pair stays small.
    """
    middle = F.radians((F.col("lat0") + F.col("lat1")) / 2.0)
    return (
        roads.withColumn("_k", F.cos(middle) * METERS_PER_DEGREE)
        .withColumns(
            {
                "_dx": short_way(F.col("lon1") - F.col("lon0")) * F.col("_k"),
                "_dy": (F.col("lat1") - F.col("lat0")) * METERS_PER_DEGREE,
            }
        )
        .withColumn(
            "_inverse",
            F.coalesce(
                F.try_divide(F.lit(1.0), F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")),
                F.lit(0.0),
            ),
        )
    )


def _squared_distance(lat: Column, lon: Column) -> Column:
    """Squared distance in metres from a point to a flattened segment."""
    x = short_way(lon - F.col("lon0")) * F.col("_k")
    y = (lat - F.col("lat0")) * METERS_PER_DEGREE
    along = (x * F.col("_dx") + y * F.col("_dy")) * F.col("_inverse")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    off_x, off_y = x - t * F.col("_dx"), y - t * F.col("_dy")
    return off_x * off_x + off_y * off_y


def segments_of(roads: DataFrame) -> DataFrame:
    """Road lines (``road_id``, ``geometry``) as two-point segments under the id of their road.

    A line of one point is a segment without length; a road without points has none.
    """
    n = F.size("geometry")
    end = lambda i: F.element_at("geometry", i)
    legs = roads.where(n > 0).select("road_id", "geometry", F.explode(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).alias("_leg"))
    first, last = end(F.col("_leg")), end(F.least(F.col("_leg") + 1, n))
    return legs.select(
        "road_id", first["lat"].alias("lat0"), first["lon"].alias("lon0"), last["lat"].alias("lat1"), last["lon"].alias("lon1")
    )


def _segment_buckets(roads: DataFrame, max_distance_m: float, step_m: float) -> DataFrame:
    """Each segment under every bucket that may hold a point near it.

    A station lists the buckets around it that the station before did not list, so nothing has to be made distinct.
    """
    length = haversine_m(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    stations = F.greatest(F.lit(1), F.ceil(length / step_m).cast("int"))
    step = step_m / METERS_PER_DEGREE
    reach = F.lit(1.01 * (max_distance_m + step_m / 2.0))

    def around(station: Column) -> Column:
        share = station / F.col("_stations")
        lat = F.col("lat0") + (F.col("lat1") - F.col("lat0")) * share
        lon = short_way(F.col("lon0") + short_way(F.col("lon1") - F.col("lon0")) * share)
        return buckets_around(lat, lon, reach, step)

    station, tasks = F.col("_station"), roads.sparkSession.sparkContext.defaultParallelism  # a small file is much work
    before = F.when(station > 0, around(station - 1)).otherwise(F.array().cast("array<bigint>"))
    return (
        _flattened(roads.repartition(tasks, "lat0", "lon0", "lat1", "lon1"))
        .withColumn("_stations", stations)
        .withColumn("_station", F.explode(F.sequence(F.lit(0), F.col("_stations"))))
        .withColumn("_bucket", F.explode(F.array_except(around(station), before)))
        .select("road_id", "lat0", "lon0", "_k", "_dx", "_dy", "_inverse", "_bucket")
    )


#: A road match first looks within this share of the distance, unless its buckets were smaller than the least step.
NARROWER, LEAST_STEP_M = 1 / 8, 50.0


def match_roads(
    df: DataFrame, roads: DataFrame, max_distance_m: float = 500.0, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Nearest road segment of each incident that has one within ``max_distance_m``.

    Segments are walked in steps of one bucket and listed under every bucket near
    the walk; incidents look up their own bucket. Ties go to the smaller road id. Every row
    is matched by itself, also where its id is null or repeated; its number is written before
    the join, so that a task that runs again finds the same one.
    Rows are matched within a short distance and small buckets first; only those that find no road there go on
    to the whole distance, so where roads are dense a row meets few of them.
    ``roads`` has two-point segments; several may belong to one road (:func:`segments_of`).
    ``carry`` names incident columns to keep, which saves joining them back.
    """
    rows = df.select("accident_id", "latitude", "longitude", *carry).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "incident-rows")
    narrow = max_distance_m * NARROWER
    rounds = [(max_distance_m, max(2.0 * max_distance_m, 1000.0))]
    if 2.0 * narrow >= LEAST_STEP_M:
        rounds.insert(0, (narrow, 2.0 * narrow))
    found = []
    for reach_m, step_m in rounds:
        if found:
            rows = written(rows.join(least.select("_row"), "_row", "left_anti"), "incident-rows")
        least, matched = _matched(rows, roads, reach_m, step_m)
        found.append(matched.select("accident_id", "road_id", round2(F.sqrt("_least")).alias("distance_meters"), *carry))
    return reduce(DataFrame.unionByName, found)


def _matched(rows: DataFrame, roads: DataFrame, reach_m: float, step_m: float) -> tuple[DataFrame, DataFrame]:
    """Rows with a road within ``reach_m``: with the least squared distance (written), and with the road at that distance as well.

    A least number needs a hash aggregate, whereas a least pair of distance and road would sort all pairs.
    """
    step = step_m / METERS_PER_DEGREE
    spread = written(_segment_buckets(roads, reach_m, step_m), "segments")

    def pairs(some: DataFrame) -> DataFrame:
        located = some.withColumn("_bucket", bucket_of(F.col("latitude"), F.col("longitude"), step))
        return located.join(spread, "_bucket").withColumn("_d2", _squared_distance(F.col("latitude"), F.col("longitude")))

    least = written(
        pairs(rows).where(F.col("_d2") <= reach_m**2).groupBy(rows.columns).agg(F.min("_d2").alias("_least")), "least-distances"
    )
    road = F.when(F.count("road_id") == F.count("*"), F.min("road_id")).alias("road_id")  # a road without an id comes first
    return least, pairs(least).where(F.col("_d2") == F.col("_least")).groupBy(least.columns).agg(road)


def road_segment_risk(df: DataFrame, roads: DataFrame, max_distance_m: float = 500.0) -> DataFrame:
    """Risk figures of each matched road segment."""
    return (
        match_roads(df, roads, max_distance_m, carry=("severity", "casualties", "fatalities"))
        .groupBy("road_id")
        .agg(*sums())
        .select(
            "road_id",
            F.col("n").alias("accident_count"),
            avg_severity().alias("avg_severity"),
            F.col("fatalities_sum").alias("total_fatalities"),
            risk_score().alias("risk_score"),
        )
        .orderBy(F.desc("risk_score"), "road_id")
    )
