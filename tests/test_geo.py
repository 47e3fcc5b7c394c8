import collections
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbwise.functions import geo
from kerbwise.operators import radius, spatial
from kerbwise.session import written
from tests.rows import make


def test_zero_is_a_coordinate_and_null_is_not(spark):
    df = spark.createDataFrame(
        [(0.0, 72.0), (19.0, 0.0), (0.0, 0.0), (None, 72.0), (19.0, None)], "latitude double, longitude double"
    )
    rows = geo.with_cell(df).withColumn("geom", geo.point(F.col("longitude"), F.col("latitude"))).collect()
    assert [r.cell is not None for r in rows] == [True, True, True, False, False]
    assert [r.geom is not None for r in rows] == [True, True, True, False, False]


def test_cell_parts_and_name(spark):
    df = spark.range(1).select(geo.pack_cell(8, F.lit(-5), F.lit(7)).alias("c"))
    row = df.select(
        geo.cell_q(F.col("c")).alias("q"), geo.cell_r(F.col("c")).alias("r"),
        geo.cell_resolution(F.col("c")).alias("res"), geo.cell_text(F.col("c")).alias("t"),
    ).first()
    assert (row.q, row.r, row.res, row.t) == (-5, 7, 8, "8:-5:7")


def plane(lat, lon, resolution):
    return (
        geo.x_scale(resolution) * math.radians(lon),
        geo.GRID_RADIUS_KM * math.sin(math.radians(lat)) / geo.GRID_PARALLEL_COS,
    )


@pytest.mark.parametrize("resolution", [6, 8, 9])
def test_point_is_nearest_to_its_own_centre(spark, resolution):
    rng = random.Random(resolution)
    points = [(rng.uniform(-80, 80), rng.uniform(-179, 179)) for _ in range(2000)]
    df = spark.createDataFrame(points, "latitude double, longitude double")
    ring = (
        geo.with_cell(df, resolution)
        .withColumn("near", F.explode(geo.ring_cells(F.col("cell"))))
        .withColumns(
            {
                "clat": geo.cell_centre_lat(F.col("near"), resolution),
                "clon": geo.cell_centre_lon(F.col("near"), resolution),
            }
        )
        .collect()
    )
    best = {}
    for r in ring:
        x, y = plane(r.latitude, r.longitude, resolution)
        cx, cy = plane(r.clat, r.clon, resolution)
        d = math.hypot(x - cx, y - cy)
        if r.near == r.cell:
            best.setdefault((r.latitude, r.longitude), [0, 9e9])[0] = d
            assert d <= geo.edge_km(resolution) * 1.0001
        else:
            slot = best.setdefault((r.latitude, r.longitude), [0, 9e9])
            slot[1] = min(slot[1], d)
    assert all(own <= other + 1e-9 for own, other in best.values())


def test_ring_is_symmetric_and_has_seven_cells(spark):
    df = spark.range(1).select(geo.pack_cell(8, F.lit(10), F.lit(-3)).alias("cell"))
    ring = df.select(F.explode(geo.ring_cells(F.col("cell"))).alias("n"), "cell")
    back = ring.select(F.explode(geo.ring_cells(F.col("n"))).alias("b"), "n", "cell")
    assert ring.select("n").distinct().count() == 7
    assert back.where("b = cell").count() == 7


@pytest.mark.parametrize("resolution", [5, 8])
def test_the_grid_closes_at_the_180th_meridian(spark, resolution):
    """Points on both sides of the meridian: one key a cell, neighbours on both sides, and all of it symmetric."""
    around = geo.cells_around(resolution)
    assert abs(geo.x_scale(resolution) / (geo.GRID_RADIUS_KM * geo.GRID_PARALLEL_COS) - 1) < 0.5 / around * 1.01
    step = 360.0 / around
    points = [(lat + 0.003 * k, lon) for lat in (-40.0, 0.0, 55.0) for k in range(40) for lon in (180.0, -180.0, 179.999, -179.999, 180 - step, step - 180)]
    df = geo.with_cell(spark.createDataFrame(points, "latitude double, longitude double"), resolution)
    cells = {(r.latitude, r.longitude): r.cell for r in df.collect()}
    assert all(cells[a, b] == cells[a, -180.0] for a, b in cells if b == 180.0)
    shared = sum(cells[a, 179.999] == cells[a, -179.999] for a, b in cells if b == 180.0)
    assert 0 < shared < 120  # the meridian runs through the middle of a cell in one row, along an edge in the next
    rings = df.select("cell").distinct().select("cell", F.explode(geo.ring_cells(F.col("cell"))).alias("n"))
    back = rings.select("cell", "n", F.explode(geo.ring_cells(F.col("n"))).alias("b"))
    assert back.where("b = cell").count() == 7 * len(set(cells.values())) == rings.distinct().count()
    centres = rings.select(geo.cell_centre_lon(F.col("n"), resolution).alias("lon"), F.round(geo.cell_centre_lat(F.col("n"), resolution), 9).alias("lat"))
    assert centres.where("lon < -180 or lon >= 180").count() == 0
    # both sides of the meridian meet in every ring of a cell that touches it
    ring_of = {}
    for r in rings.collect():
        ring_of.setdefault(r.cell, set()).add(r.n)
    assert all(cells[a, 179.999] in ring_of[cells[a, -179.999]] for a, b in cells if b == 180.0)


def test_density_adds_up_across_the_180th_meridian(spark):
    rows = [(10.0, 179.9995)] * 3 + [(10.0, -179.9995)] * 4 + [(10.0, -179.99)] * 5
    df = geo.with_cell(spark.createDataFrame(rows, "latitude double, longitude double"))
    found = spatial.cell_density(df).collect()
    assert sum(r.cell_density for r in found) == 12
    assert {round(7 * r.neighbor_density) for r in found} == {12}


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = (
        math.sin((p2 - p1) / 2) ** 2
        + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    )
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, a)))


EDGES = [(0.0, 179.999), (0.0, -179.999), (89.99, 10.0), (89.99, -170.0), (-89.995, 0.0), (60.0, 179.98)]


def _cloud(seed, n):
    rng = random.Random(seed)
    out = list(EDGES)
    for lat, lon in EDGES + [(15.0, 75.5), (-33.0, 151.0)]:
        for _ in range(n):
            la = max(-90.0, min(90.0, lat + rng.uniform(-0.08, 0.08)))
            lo = (lon + rng.uniform(-0.2, 0.2) + 180.0) % 360.0 - 180.0
            out.append((la, lo))
    return out


@pytest.mark.parametrize("radius_m", [500.0, 5000.0, 60000.0])
def test_radius_join_equals_all_pairs(spark, radius_m):
    points, centers = _cloud(1, 40), _cloud(2, 8)
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id int, latitude double, longitude double")
    c = spark.createDataFrame(
        [(i, *x) for i, x in enumerate(centers)], "k int, center_lat double, center_lon double"
    )
    joined = radius.radius_join(p, c, radius_m).select("id", "k").collect()
    got = {(r.id, r.k) for r in joined}
    assert len(joined) == len(got)
    want = {
        (i, k)
        for i, (la, lo) in enumerate(points)
        for k, (ca, co) in enumerate(centers)
        if haversine(ca, co, la, lo) <= radius_m
    }
    assert got == want and want


@settings(max_examples=8, deadline=None)
@given(
    lat=st.floats(-89.9, 89.9), lon=st.floats(-180, 179.99), radius_m=st.sampled_from([800.0, 9000.0, 300000.0])
)
def test_search_equals_distance_filter(spark, lat, lon, radius_m):
    rng = random.Random(7)
    reach = radius_m / 80000.0
    points = [
        {
            "latitude": max(-90.0, min(90.0, lat + rng.uniform(-reach, reach))),
            "longitude": (lon + rng.uniform(-reach, reach) * 3 + 180.0) % 360.0 - 180.0,
        }
        for _ in range(60)
    ]
    got = {r.accident_id for r in radius.within_radius(make(spark, *points, cell=False), lat, lon, radius_m).collect()}
    want = {
        f"ACC_{i + 1:06d}"
        for i, p in enumerate(points)
        if haversine(lat, lon, p["latitude"], p["longitude"]) <= radius_m
    }
    assert got == want


def test_search_order_rounding_and_boundary(spark):
    meters = haversine(10.0, 20.0, 10.01, 20.0)
    df = make(spark, {"latitude": 10.0, "longitude": 20.0}, {"latitude": 10.01, "longitude": 20.0}, cell=False)
    got = radius.within_radius(df, 10.0, 20.0, meters * (1 + 1e-12)).collect()
    assert [(r.accident_id, r.distance_meters) for r in got] == [
        ("ACC_000001", 0.0), ("ACC_000002", round(meters, 2)),
    ]
    assert radius.within_radius(df, 10.0, 20.0, meters - 0.01).count() == 1


def test_wkt(spark):
    row = spark.range(1).select(geo.point_wkt(F.lit(-72.5), F.lit(18.1234565)).alias("w")).first()
    assert row.w == "POINT (-72.500000 18.123457)"


def test_road_match_equals_all_pairs(spark):
    rng = random.Random(3)
    roads = [
        (i, "c", "primary", la, lo, la + rng.uniform(-0.05, 0.05), lo + rng.uniform(-0.05, 0.05))
        for i, (la, lo) in enumerate((rng.uniform(15, 15.1), rng.uniform(75, 75.1)) for _ in range(15))
    ]
    roads.append((99, "c", "primary", 15.05, 75.05, 15.05, 75.05))  # no length
    points = [{"latitude": rng.uniform(14.95, 15.15), "longitude": rng.uniform(74.95, 75.15)} for _ in range(150)]
    r = spark.createDataFrame(
        roads, "road_id long, city string, highway string, lat0 double, lon0 double, lat1 double, lon1 double"
    )
    got = {
        x.accident_id: (x.road_id, x.distance_meters)
        for x in radius.match_roads(make(spark, *points, cell=False), r, 700.0).collect()
    }

    def away(p, road):
        k = math.cos(math.radians((road[3] + road[5]) / 2)) * geo.METERS_PER_DEGREE
        x0, y0 = (road[4] - p["longitude"]) * k, (road[3] - p["latitude"]) * geo.METERS_PER_DEGREE
        x1, y1 = (road[6] - p["longitude"]) * k, (road[5] - p["latitude"]) * geo.METERS_PER_DEGREE
        dx, dy = x1 - x0, y1 - y0
        n = dx * dx + dy * dy
        t = 0.0 if n == 0 else max(0.0, min(1.0, -(x0 * dx + y0 * dy) / n))
        return math.hypot(x0 + t * dx, y0 + t * dy)

    want = {}
    for i, p in enumerate(points):
        d, road_id = min((away(p, road), road[0]) for road in roads)
        if d <= 700.0:
            want[f"ACC_{i + 1:06d}"] = (road_id, d)
    assert got.keys() == want.keys() and want
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 0.01 for k in want)


def test_roads_across_the_date_line_and_rows_without_ids(spark):
    from kerbwise.operators.radius import match_roads

    points = spark.createDataFrame(
        [("a", 0.0, 179.9995), ("b", 0.0, -179.9995), ("c", 0.001, 180.0), (None, 0.0, 10.0), (None, 0.0, 10.001), ("d", 0.0, 10.0), ("d", 0.0, 10.002), ("far", 0.0, 0.0)],
        "accident_id string, latitude double, longitude double",
    )
    roads = spark.createDataFrame(
        [("east", 0.0, -179.9985, 0.0, -179.99), ("across", 0.001, 179.99, 0.001, -179.99), ("plain", 0.0, 9.99, 0.0, 10.01)],
        "road_id string, lat0 double, lon0 double, lat1 double, lon1 double",
    )
    got = sorted(map(str, match_roads(points, roads, 500.0).select("accident_id", "road_id", "distance_meters").collect()))
    assert len(got) == 7
    by_id = {r.accident_id: r for r in match_roads(points, roads, 500.0).collect()}
    assert by_id["c"].road_id == "across" and by_id["c"].distance_meters == 0.0
    assert {by_id["a"].road_id, by_id["b"].road_id} <= {"across", "east"} and 110 < by_id["b"].distance_meters < 112
    assert match_roads(points, roads.where("road_id = 'east'"), 500.0).where("accident_id = 'a'").first().distance_meters > 200


@pytest.mark.parametrize("radius_m", [700.0, 9000.0, 60000.0])
def test_figures_around_centers_equal_those_of_all_pairs_without_making_them(spark, monkeypatch, radius_m):
    rng = random.Random(5)
    points = _cloud(1, 40) + [(15 + rng.gauss(0, 0.05), 75 + rng.gauss(0, 0.05)) for _ in range(1500)] + [(15.01, 75.02)] * 300
    points += [(89.999, -10.0), (0.0, 179.9999), (91.0, 20.0), (None, 1.0), (15.0, None)]
    places = _cloud(2, 8) + [(15 + rng.gauss(0, 0.05), 75 + rng.gauss(0, 0.05)) for _ in range(25)]
    places += [(89.9999, 170.0), (0.0, -180.0), (92.0, 20.0), (None, 3.0), (15.0, 75.0), (15.0, 75.0)]
    p = spark.createDataFrame(
        [(*x, (None, 1, 2, 3)[i % 4], 1, 0) for i, x in enumerate(points)],
        "latitude double, longitude double, severity int, casualties int, fatalities int",
    )
    keys = [(None if i % 7 == 0 else i // 2, *x) for i, x in enumerate(places)]  # keys repeat and are null
    c = spark.createDataFrame(keys, "k int, center_lat double, center_lon double")
    figures = (
        radius.radius_join(p, c, radius_m).groupBy("k")
        .agg(F.count("*"), F.avg("severity"), F.count_if(F.col("severity") == 3), F.round(F.min("distance_m"), 2)).collect()
    )
    want = sorted((tuple(r) for r in figures), key=str)

    def pairs(*_):
        raise AssertionError("pairs of all incidents")

    monkeypatch.setattr(radius, "radius_join", pairs)
    got = sorted((tuple(r) for r in radius.incidents_around(p, c, "k", radius_m).collect()), key=str)
    assert [r[:2] + r[3:4] for r in got] == [r[:2] + r[3:4] for r in want] and len(want) > 5
    for mine, theirs in zip(got, want):
        assert mine[2] == pytest.approx(theirs[2]) and mine[4] == pytest.approx(theirs[4], abs=0.011)


def test_incidents_far_from_the_edge_of_a_circle_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    points = [(15 + rng.uniform(-0.1, 0.1), 75 + rng.uniform(-0.1, 0.1)) for _ in range(20000)]
    p = spark.createDataFrame([(*x, 1) for x in points], "latitude double, longitude double, severity int")
    c = spark.createDataFrame([(0, 15.0, 75.0)], "k int, center_lat double, center_lon double")
    rows, squares = radius._levels(p, 5000.0)
    labels = collections.Counter()

    def counted(df, label):
        out = written(df, label)
        labels[label] += out.count()
        return out

    monkeypatch.setattr(radius, "written", counted)
    spread = c.withColumn("_bucket", F.explode(radius.buckets_around(F.col("center_lat"), F.col("center_lon"), F.lit(5000.0), 5000.0 / radius.METERS_PER_DEGREE)))
    inside = radius._totals_within(spread, rows, squares, 5000.0).first().n
    assert inside == sum(haversine(15.0, 75.0, *x) <= 5000.0 for x in points)
    assert len(squares) > 1 and sum(labels.values()) < inside / 10


def test_road_match_sorts_no_pairs(spark, monkeypatch):
    """Pairs of incidents and roads meet hash aggregates only, and an incident near a road meets few of them."""
    from kerbwise.operators import radius

    roads = spark.createDataFrame(
        [(i, 15.0 + i / 1000, 75.0, 15.0 + i / 1000, 75.001) for i in range(40)] + [(90, 15.0, 75.0, 15.0, 75.001)],
        "road_id long, lat0 double, lon0 double, lat1 double, lon1 double",
    )
    spots = [{"accident_id": f"a{k}", "latitude": 15.0 + k / 10000, "longitude": lon} for k in range(60) for lon in (75.0005, 75.004, 75.02)]
    plans, real = [], radius.written
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())

    def written(df, label):
        seen(df)
        return real(df, label)

    monkeypatch.setattr(radius, "written", written)
    matched = radius.match_roads(make(spark, *spots, cell=False), roads, 500.0)
    seen(matched)
    assert any("HashAggregate" in text for text in plans) and not any("SortAggregate" in text for text in plans)
    got = matched.collect()
    assert len(got) == 120 and all(r.road_id == (int(r.accident_id[1:]) + 5) // 10 for r in got if int(r.accident_id[1:]) % 10 != 5)
