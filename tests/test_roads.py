"""Overlay, network distances and buffered hotspots against brute force."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbwise.functions import geo
from kerbwise.operators import buffered, network, overlay, radius
from kerbwise.session import written

SEGMENT = "road_id long, lat0 double, lon0 double, lat1 double, lon1 double"


def meters(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, a)))


def lines(n, seed, lat=15.0, lon=75.0):
    rng = random.Random(seed)
    rows = [(i, *(p + rng.uniform(-0.05, 0.05) for p in (lat, lon, lat, lon))) for i in range(n)]
    rows += [(n, lat, lon, lat, lon), (n + 1, lat, lon, lat, lon + 0.03), (n + 2, lat, lon, lat + 0.03, lon), (n + 3, None, lon, lat, lon)]
    return rows


@pytest.mark.parametrize("lat, lon, resolution", [(15.0, 75.0, 8), (-62.0, 179.99, 8), (0.0, -179.98, 9)])
def test_pieces_of_roads_add_up_and_lie_in_their_cells(spark, lat, lon, resolution):
    rows = lines(40, 1, lat, lon)
    rows = [(i, a, (b + 180) % 360 - 180 if b is not None else b, c, (d + 180) % 360 - 180) for i, a, b, c, d in rows]
    found = collections.defaultdict(dict)
    for r in overlay.road_cells(spark.createDataFrame(rows, SEGMENT), resolution).collect():
        found[r.road_id][r.cell] = r.length_m
    assert set(found) == set(range(len(rows) - 1))
    # brute force: the cells of 4001 points along each road
    steps = 4000
    points, scale = [], geo.x_scale(resolution)
    for i, a, b, c, d in rows[:-1]:
        east = (d - b + 180) % 360 - 180
        y0, y1 = math.sin(math.radians(a)), math.sin(math.radians(c))
        for k in range(steps):
            t = (k + 0.5) / steps
            x = b + east * t
            points.append((i, math.degrees(math.asin(y0 + (y1 - y0) * t)), (x + 180) % 360 - 180))
    cells = geo.with_cell(spark.createDataFrame(points, "road_id long, latitude double, longitude double"), resolution)
    counts = collections.defaultdict(dict)
    for r in cells.groupBy("road_id", "cell").count().collect():
        counts[r.road_id][r.cell] = r["count"]
    for i, a, b, c, d in rows[:-1]:
        whole = meters(a, b, c, d)
        assert sum(found[i].values()) == pytest.approx(whole, abs=1e-6)
        for cell in set(found[i]) | set(counts[i]):
            assert found[i].get(cell, 0.0) == pytest.approx(counts[i].get(cell, 0) / steps * whole, abs=2.1 * whole / steps + 1e-6)
    assert scale > 0 and len({c for v in found.values() for c in v}) > 20


def test_incidents_for_each_kilometre(spark):
    roads = spark.createDataFrame(lines(10, 2), SEGMENT)
    cells = overlay.road_cells(roads)
    busy, idle = (r.cell for r in cells.select("cell").distinct().orderBy("cell").limit(2).collect())
    incidents = spark.createDataFrame([(busy, 3)] * 5 + [(busy, 1)] * 2 + [(1, 2)], "cell long, severity int")
    got = {r.cell: r for r in overlay.cell_road_risk(incidents, roads).collect()}
    assert set(got) == {r.cell for r in cells.collect()}
    assert (got[busy].accident_count, got[idle].accident_count, got[idle].avg_severity) == (7, 0, None)
    assert got[busy].accidents_per_km == pytest.approx(7 / got[busy].road_km, abs=1e-6) and got[busy].avg_severity == pytest.approx(17 / 7)


def shortest(ways, sources, reach):
    """All pairs by Floyd and Warshall."""
    nodes = sorted({x for u, v, _ in ways for x in (u, v)} | set(sources))
    best = {(a, b): 0.0 if a == b else math.inf for a in nodes for b in nodes}
    for u, v, d in ways:
        best[u, v] = min(best[u, v], d)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                best[a, b] = min(best[a, b], best[a, k] + best[k, b])
    return {(a, b): d for (a, b), d in best.items() if a in sources and d <= reach}


def test_distances_equal_all_pairs_shortest_paths(spark):
    rng = random.Random(4)
    ways = [(u, v, rng.choice([0.0, 100.0, 250.0, 400.0, 990.0])) for u in range(40) for v in rng.sample(range(40), 2) if u != v]
    ways += [(v, u, d) for u, v, d in ways]
    table = spark.createDataFrame(ways, "u long, v long, length_m double").groupBy("u", "v").agg(F.min("length_m").alias("length_m"))
    sources = [0, 7, 13, 99]
    for reach in (300.0, 1000.0):
        got = network.distances(table, spark.createDataFrame([(s,) for s in sources * 2], "node long"), reach).collect()
        assert {(r.source, r.node): r.distance_m for r in got} == shortest(ways, sources, reach) and len(got) == len({(r.source, r.node) for r in got})


def test_nodes_are_snapped_and_close_at_the_180th_meridian(spark):
    df = spark.createDataFrame([(10.0, 180.0), (10.0, -180.0), (10.0001, 179.9999), (10.0, 179.0), (None, 1.0)], "a double, b double")
    got = [r.n for r in df.select(network.node_of(F.col("a"), F.col("b"), 1000.0).alias("n")).collect()]
    assert got[0] == got[1] == got[2] != got[3] and got[4] is None


def test_risk_spreads_along_the_network(spark):
    # a chain of four roads of some 1.1 km and one apart; incidents on the first
    roads = [(i, 15.0, 75.0 + 0.01 * i, 15.0, 75.0 + 0.01 * (i + 1)) for i in range(4)] + [(9, 15.5, 75.0, 15.5, 75.01)]
    incidents = spark.createDataFrame([(f"a{i}", 15.0001, 75.005, 2) for i in range(6)], "accident_id string, latitude double, longitude double, severity int")
    got = {r.road_id: r for r in network.network_risk(incidents, spark.createDataFrame(roads, SEGMENT), 100.0, 2500.0).collect()}
    d = meters(15.0, 75.0, 15.0, 75.01)
    assert (got[0].accident_count, got[0].weight, got[1].accident_count, got[9].network_risk) == (6, 12, 0, 0.0)
    share = lambda x: max(0.0, 1 - x / 2500.0)
    node = [6 * (share(abs(k) * d) + share(abs(k - 1) * d)) for k in range(5)]
    for i in range(4):
        assert got[i].network_risk == pytest.approx((node[i] + node[i + 1]) / 2)
    assert got[3].network_risk < got[2].network_risk < got[1].network_risk < got[0].network_risk


def brute_hotspots(points, buffer_m, least):
    """Density clusters over sites by all pairs."""
    per = buffered.SITES_PER_DEGREE
    count = collections.Counter(
        (math.floor((a + 90.0) * per + 0.5), math.floor((b + 180.0) * per + 0.5) % (360 * per)) for a, b in points if a is not None and b is not None
    )
    site = {k: (k[0] / per - 90.0, k[1] / per - 180.0) for k in count}
    near = {k: [m for m in count if meters(*site[k], *site[m]) <= buffer_m] for k in count}
    core = {k for k in count if sum(count[m] for m in near[k]) >= least}
    name = {}
    for k in sorted(core):
        if k in name:
            continue
        stack, name[k] = [k], k
        while stack:
            for m in near[stack.pop()]:
                if m in core and m not in name:
                    name[m] = k
                    stack.append(m)
    out = dict(name)
    for k in set(count) - core:
        reach = [(meters(*site[k], *site[m]), name[m]) for m in near[k] if m in core]
        if reach:
            out[k] = min(reach)[1]
    key = lambda k: k[0] * 360 * per + k[1]
    return {key(k): key(v) for k, v in out.items()}, {key(k) for k in core}


@pytest.mark.parametrize("lon", [75.0, 179.997])
def test_buffered_hotspots_equal_brute_force(spark, lon):
    rng = random.Random(7)
    turn = lambda b: (b + 180) % 360 - 180
    points = [(15 + rng.gauss(0, 0.01), turn(lon + rng.gauss(0, 0.01))) for _ in range(400)]
    points += [(15.05 + 0.003 * i, turn(lon)) for i in range(30) for _ in range(3)]  # a long chain
    points += [(14.9, turn(lon))] * 300 + [(14.9, None), (None, None)]
    df = spark.createDataFrame([(a, b, 1 + i % 3) for i, (a, b) in enumerate(points)], "latitude double, longitude double, severity int")
    placed = written(buffered.sites(df), "sites")
    got = buffered.site_hotspots(placed, 500.0, 5).collect()
    want, core = brute_hotspots(points, 500.0, 5)
    assert {r.site: r.hotspot for r in got} == want and {r.site for r in got if r.is_core} == core and len(got) == len(want)
    assert len(set(want.values())) > 2 and len(want) > len(core)
    figures = buffered.buffered_hotspots(df).collect()
    assert len(figures) == len(set(want.values())) and sum(r.sites for r in figures) == len(want)
    chain = max(figures, key=lambda r: r.hotspot)
    assert (chain.accident_count, chain.center_lon) == (90, pytest.approx(lon)) and chain.center_lat == pytest.approx(15.05 + 0.003 * 14.5, abs=1e-4)
    assert buffered.buffered_hotspots(df.where("false")).count() == 0


def test_buffered_hotspots_of_a_crowded_place_keep_no_pairs(spark, monkeypatch):
    kept = []

    def counted(df, label):
        out = written(df, label)
        kept.append((out.count(), label))
        return out

    for module in (buffered, radius):
        monkeypatch.setattr(module, "written", counted)
    crowd = [(15 + i * 1e-4, 75 + j * 1e-4) for i in range(40) for j in range(40)]
    near = [(15.0039 + 0.004, 75.0 + 0.001 * k) for k in range(3)]  # beyond the crowd, reached by its edge
    df = spark.createDataFrame([(a, b, 1) for a, b in (crowd + near) for _ in range(2)], "latitude double, longitude double, severity int")
    figures = buffered.buffered_hotspots(df).collect()
    assert [(r.sites, r.accident_count) for r in figures] == [(1603, 3206)]
    assert max(kept)[0] <= 20 * 1603, max(kept)


@pytest.mark.parametrize("pole", [90, -90])
def test_buffered_hotspots_at_the_poles_equal_brute_force(spark, pole):
    rng = random.Random(11)
    points = [(pole * (1 - abs(rng.gauss(0, 1e-4))), rng.uniform(-180, 179.9)) for _ in range(120)]
    df = spark.createDataFrame([(a, b, 1) for a, b in points], "latitude double, longitude double, severity int")
    got = buffered.site_hotspots(written(buffered.sites(df), "sites"), 300.0, 4).collect()
    want, core = brute_hotspots(points, 300.0, 4)
    assert {r.site: r.hotspot for r in got} == want and {r.site for r in got if r.is_core} == core and want
