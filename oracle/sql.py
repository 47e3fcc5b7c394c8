"""DuckDB SQL for the registered queries.

Each statement starts from the same derivation of incidents, roads and requests
as the Spark sources, spelled out as common table expressions.
"""

from __future__ import annotations

import math

from kerbwise import fixed
from kerbwise.functions import geo
from kerbwise.plans import registry as reg
from kerbwise.sources import synthetic

RES = geo.GRID_BASE_RESOLUTION
EDGE = geo.edge_km(RES)
AROUND = round(2.0 * math.pi * geo.GRID_RADIUS_KM * geo.GRID_PARALLEL_COS / (3.0**0.5 * EDGE))
KX = AROUND * 3.0**0.5 * EDGE / (2.0 * math.pi)
KY = geo.GRID_RADIUS_KM / geo.GRID_PARALLEL_COS
SPAN, SHIFT = geo.AXIS_SPAN, geo.AXIS_SHIFT


def num(value: float) -> str:
    """A double literal with all its digits (a plain literal would be a decimal)."""
    return f"CAST('{value!r}' AS DOUBLE)"


def cells(source: str, lat: str = "latitude", lon: str = "longitude") -> str:
    """CTEs that add ``cell`` to ``source``; the last one is named ``<source>_c``."""
    third, scale3 = num(2.0 / 3.0), num(3.0**0.5 / 3.0)
    return f"""
{source}_p AS (SELECT *, radians({lon}) * {num(KX)} AS px, sin(radians({lat})) * {num(KY)} AS py FROM {source}),
{source}_f AS (SELECT *, (px * {scale3} - py / 3.0::DOUBLE) / {num(EDGE)} AS qf,
                       py * {third} / {num(EDGE)} AS rf FROM {source}_p),
{source}_h AS (SELECT *, floor(qf + 0.5::DOUBLE) AS cq, floor(rf + 0.5::DOUBLE) AS cr,
                       floor(0.5::DOUBLE - qf - rf) AS cs FROM {source}_f),
{source}_d AS (SELECT *, abs(cq - qf) AS dq, abs(cr - rf) AS dr, abs(cs + qf + rf) AS ds FROM {source}_h),
{source}_c AS (SELECT * EXCLUDE (px, py, qf, rf, cq, cr, cs, dq, dr, ds),
  {RES * SPAN * SPAN}::BIGINT
  + (CAST(CASE WHEN dq > dr AND dq > ds THEN -cr - cs ELSE cq END AS BIGINT) + {SHIFT}) * {SPAN}
  + (CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -cq - cs ELSE cr END AS BIGINT) + {SHIFT})
  AS cell FROM {source}_d)"""


def _case(column: str, names: dict) -> str:
    return "CASE " + " ".join(f"WHEN {column} = {k!r} THEN '{v}'" for k, v in names.items()) + " END"


FACT = f"""
raw0 AS (
  SELECT event_id, n_name AS city, r_name AS state,
    8000000 + 1000000 * n_nationkey::BIGINT + CAST(floor(((event_id * 7919) % 2001 - 1000)
      * abs((event_id * 7919) % 2001 - 1000) / 10.0::DOUBLE) AS BIGINT) AS lat_e6,
    72000000 + 500000 * n_nationkey::BIGINT + CAST(floor(((event_id * 104729) % 1999 - 999)
      * abs((event_id * 104729) % 1999 - 999) / 10.0::DOUBLE) AS BIGINT) AS lon_e6,
    CAST(strftime(o_orderdate, '%Y-%m-%d') || ' ' || strftime(ts, '%H:%M:%S') AS TIMESTAMP) AS accident_datetime,
    CAST(o_orderdate AS DATE) AS date, strftime(ts, '%H:%M:%S') AS time, ts,
    CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week,
    CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS INTEGER) AS year,
    CASE WHEN value > 150 THEN 3 WHEN value > 60 THEN 2 ELSE 1 END AS severity,
    (event_id * 31 + user_id) % 100 AS draw, event_type, c_mktsegment,
    CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INTEGER) AS casualties,
    CASE WHEN value > 150 OR event_id % 10 = 0 THEN 1 ELSE 0 END AS fatalities
  FROM events JOIN orders ON o_orderkey = event_id JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
raw AS (
  SELECT format('ACC_{{:06d}}', event_id + 1) AS accident_id, city, state,
    lat_e6 / 1e6::DOUBLE AS latitude, lon_e6 / 1e6::DOUBLE AS longitude, accident_datetime, date, time,
    hour, day_of_week, month, year, severity,
    {_case('severity', fixed.SEVERITY_LABELS)} AS severity_label,
    CASE WHEN draw < 40 THEN 'Car' WHEN draw < 70 THEN 'Motorcycle' WHEN draw < 80 THEN 'Bus'
         WHEN draw < 90 THEN 'Truck' WHEN draw < 98 THEN 'Auto-rickshaw' ELSE 'Bicycle' END AS vehicle_type,
    CASE event_type WHEN 'click' THEN 'City Road' WHEN 'view' THEN 'City Road' WHEN 'error' THEN 'Highway'
         WHEN 'signup' THEN 'Rural Road' WHEN 'purchase' THEN 'Residential' END AS road_type,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Clear' WHEN 'BUILDING' THEN 'Clear' WHEN 'FURNITURE' THEN 'Rain'
         WHEN 'HOUSEHOLD' THEN 'Fog' WHEN 'MACHINERY' THEN 'Night' END AS weather,
    casualties, fatalities,
    greatest(0, casualties - CASE WHEN severity = 3 THEN 1 ELSE 0 END) AS injured,
    lat_e6, lon_e6, ts, event_id
  FROM raw0),
{cells('raw')},
inc AS (SELECT * FROM raw_c)"""

COLUMNS = ", ".join(reg.wh.INCIDENT_COLUMNS)

ROADS = """
road0 AS (
  SELECT s_suppkey + 1 AS road_id, n_name AS city,
    CASE s_suppkey % 4 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary' WHEN 2 THEN 'secondary'
         ELSE 'residential' END AS highway, s_suppkey AS k,
    8000000 + 1000000 * n_nationkey::BIGINT + ((s_suppkey * 7919) % 1201 - 600) * 100 AS a,
    72000000 + 500000 * n_nationkey::BIGINT + ((s_suppkey * 104729) % 1201 - 600) * 100 AS b
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
road AS (
  SELECT road_id, city, highway, a / 1e6::DOUBLE AS lat0, b / 1e6::DOUBLE AS lon0,
    (a + ((k * 31) % 201 - 100) * 200) / 1e6::DOUBLE AS lat1,
    (b + ((k * 37) % 201 - 100) * 200) / 1e6::DOUBLE AS lon1 FROM road0)"""

REQUESTS = """
req0 AS (
  SELECT c_custkey AS request_id, n_name AS city, r_name AS state, c_acctbal, c_mktsegment,
    8000000 + 1000000 * n_nationkey::BIGINT + ((c_custkey * 7919) % 401 - 200) * 100 AS a,
    72000000 + 500000 * n_nationkey::BIGINT + ((c_custkey * 104729) % 401 - 200) * 100 AS b
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
req AS (
  SELECT request_id, city, state,
    CASE WHEN c_acctbal < 0 THEN a / 1e6::DOUBLE + 90.0::DOUBLE ELSE a / 1e6::DOUBLE END AS latitude,
    b / 1e6::DOUBLE AS longitude, CAST(request_id % 25 AS INTEGER) AS hour,
    ['Car','Motorcycle','Bus','Truck','Auto-rickshaw','Bicycle','Tractor'][request_id % 7 + 1] AS vehicle_type,
    ['Highway','City Road','Rural Road','Residential','Track'][request_id % 5 + 1] AS road_type,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'Rain' WHEN 'HOUSEHOLD' THEN 'Fog'
         WHEN 'MACHINERY' THEN 'Snow' END AS weather
  FROM req0)"""

AVG_SEV = "CAST(sum(severity) AS DOUBLE) / count(severity)"
AVG_LAT = "CAST(sum(lat_e6) AS DOUBLE) / count(*) / 1e6::DOUBLE"
AVG_LON = "CAST(sum(lon_e6) AS DOUBLE) / count(*) / 1e6::DOUBLE"


def total(column: str) -> str:
    return f"CAST(sum({column}) AS BIGINT)"


def round2(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,8)), 2) AS DOUBLE)"


def bround2(value: str) -> str:
    """Half to even by way of a decimal."""
    return f"CAST(round_even(CAST({value} AS DECIMAL(18,8)), 2) AS DOUBLE)"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2.0::DOUBLE)"
    b = f"sin(radians({lon2} - {lon1}) / 2.0::DOUBLE)"
    return (
        f"{num(2.0 * geo.EARTH_RADIUS_M)} * asin(sqrt(least(1.0::DOUBLE, {a} * {a} + "
        f"cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b})))"
    )


def fact(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([FACT, *more]) + "\n" + body


def category(hour: str, morning, evening, night) -> str:
    return (
        f"CASE WHEN {hour} BETWEEN {morning[0]} AND {morning[1]} THEN 'Morning Rush' "
        f"WHEN {hour} BETWEEN {evening[0]} AND {evening[1]} THEN 'Evening Rush' "
        f"WHEN {hour} >= {night[0]} OR {hour} <= {night[1]} THEN 'Night' ELSE 'Regular Hours' END"
    )


SPARK_CATEGORY = category("hour", (7, 10), (17, 20), (21, 5))
WAREHOUSE_CATEGORY = category("hour", (6, 10), (17, 21), (22, 5))
SEASON = (
    "CASE WHEN month IN (12,1,2) THEN 'Winter' WHEN month IN (3,4,5) THEN 'Spring' "
    "WHEN month IN (6,7,8,9) THEN 'Monsoon' ELSE 'Post-Monsoon' END"
)
IS_RUSH = "(hour BETWEEN 7 AND 10 OR hour BETWEEN 17 AND 20)"
IS_NIGHT = "(hour < 6 OR hour > 22)"
WEEKEND = "day_of_week IN (5, 6)"


def quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


RISK = """risk AS (
  SELECT city, road_type, vehicle_type, weather, count(*) AS accident_count,
    CAST(sum(severity) AS DOUBLE) / count(*) AS avg_severity, CAST(sum(fatalities) AS BIGINT) AS total_fatalities,
    CAST(round(CAST(CAST(sum(severity) + 3 * sum(fatalities) AS DOUBLE) / count(*) AS DECIMAL(18,8)), 2) AS DOUBLE)
      AS risk_score
  FROM inc GROUP BY city, road_type, vehicle_type, weather HAVING count(*) >= 5)"""

CLUSTERS = f"""clusters AS (
  SELECT cell, city, state, count(*) AS accident_count, {AVG_SEV} AS avg_severity,
    {total('casualties')} AS total_casualties, {total('fatalities')} AS total_fatalities,
    {total('injured')} AS total_injured, min(date) AS earliest_accident, max(date) AS latest_accident,
    CAST(year(min(accident_datetime)) AS INTEGER) AS earliest_year,
    CAST(year(max(accident_datetime)) AS INTEGER) AS latest_year,
    {AVG_LAT} AS center_lat, {AVG_LON} AS center_lon
  FROM inc GROUP BY cell, city, state HAVING count(*) >= 3)"""

HOTSPOT_VIEW = """SELECT cell, city, state, accident_count, avg_severity, total_casualties, total_fatalities,
  total_injured, center_lat AS centroid_lat, center_lon AS centroid_lon, earliest_year, latest_year FROM clusters"""

DENSITY = f"""counts AS (SELECT cell, count(*) AS n FROM inc GROUP BY cell),
shifts AS (SELECT unnest([{', '.join(str(dq * SPAN + dr) for dq, dr in geo.RING_OFFSETS)}]::BIGINT[]) AS shift),
density AS (
  SELECT c.cell, c.n AS cell_density, CAST(sum(coalesce(o.n, 0)) AS DOUBLE) / 7 AS neighbor_density
  FROM counts c CROSS JOIN shifts LEFT JOIN counts o ON o.cell = c.cell + shift GROUP BY c.cell, c.n)"""

RATES = """by_city AS (SELECT city, CAST(sum(severity) AS DOUBLE) / count(*) AS city_avg_severity,
    round(stddev_samp(severity), 6) AS city_severity_std,
    CAST(sum(casualties) AS DOUBLE) / count(*) AS city_avg_casualties FROM inc GROUP BY city),
by_road AS (SELECT road_type, CAST(sum(severity) AS DOUBLE) / count(*) AS road_type_risk FROM inc GROUP BY road_type),
by_vehicle AS (SELECT vehicle_type, CAST(sum(severity) AS DOUBLE) / count(*) AS vehicle_type_risk
  FROM inc GROUP BY vehicle_type)"""

FLAGS = f"""CAST({WEEKEND} AS INTEGER) AS is_weekend, CAST({IS_RUSH} AS INTEGER) AS is_rush_hour,
  CAST({IS_NIGHT} AS INTEGER) AS is_night, {SEASON} AS season"""


def mode_of(column: str, name: str) -> str:
    """CTE with the most frequent value of ``column`` per cell, smallest on a tie."""
    return f"""{name} AS (SELECT cell, {column} AS {name}_value FROM (
  SELECT cell, {column}, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, {column}) AS rn
  FROM inc GROUP BY cell, {column}) WHERE rn = 1)"""


def temporal(key: str, where: str = "") -> str:
    return fact(
        f"SELECT {key}, count(*) AS accident_count, {AVG_SEV} AS avg_severity, "
        f"{total('casualties')} AS total_casualties FROM inc {where} GROUP BY {key}"
    )


def labels(columns: list[str], source: str = "inc") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS value, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
        f"FROM (SELECT DISTINCT {c} FROM {source})"
        for c in columns
    )


def segment_distance(segments: str = "road") -> str:
    """CTEs ``near``: incident, road and their distance, for all pairs with one of ``segments``."""
    m = num(geo.METERS_PER_DEGREE)
    return f"""
flat AS (SELECT *, cos(radians((lat0 + lat1) / 2.0::DOUBLE)) * {m} AS k FROM {segments}),
pairs AS (SELECT accident_id, road_id, severity, fatalities, (lon1 - lon0) * k AS dx, (lat1 - lat0) * {m} AS dy,
    (longitude - lon0) * k AS x, (latitude - lat0) * {m} AS y
  FROM inc JOIN flat ON abs(lat0 - latitude) < 0.1 AND abs(lon0 - longitude) < 0.1),
feet AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x * dx + y * dy) / (dx * dx + dy * dy))) END AS t FROM pairs),
near AS (SELECT accident_id, road_id, severity, fatalities,
    sqrt((x - t * dx) * (x - t * dx) + (y - t * dy) * (y - t * dy)) AS d FROM feet),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY accident_id ORDER BY d, road_id) AS rn
  FROM near WHERE d <= {reg.ROAD_DISTANCE_M}) WHERE rn = 1)"""


#: Each road as two segments that meet in its middle.
HALVES = """
half AS (
  SELECT road_id, lat0, lon0, (lat0 + lat1) / 2 AS lat1, (lon0 + lon1) / 2 AS lon1 FROM road
  UNION ALL SELECT road_id, (lat0 + lat1) / 2, (lon0 + lon1) / 2, lat1, lon1 FROM road)"""


#: Roads cut where one of the grid's three families of lines is crossed.
ROAD_CELLS = f"""
plane AS (
  SELECT road_id, {haversine('lat0', 'lon0', 'lat1', 'lon1')} AS whole, radians(lon0) * {num(KX)} AS x0, radians(lon1) * {num(KX)} AS x1,
    sin(radians(lat0)) * {num(KY)} AS y0, sin(radians(lat1)) * {num(KY)} AS y1 FROM road),
family AS (
  SELECT road_id, kx * x0 + ky * y0 AS a, kx * x1 + ky * y1 AS b FROM plane,
    (VALUES ({num(2 * 3**-0.5 / EDGE)}, 0.0::DOUBLE), ({num(3**-0.5 / EDGE)}, {num(1 / EDGE)}), ({num(3**-0.5 / EDGE)}, {num(-1 / EDGE)})) k(kx, ky)),
cuts AS (
  SELECT road_id, (m - a) / (b - a) AS t FROM (
    SELECT road_id, a, b, unnest(range(ceil(least(a, b))::BIGINT, floor(greatest(a, b))::BIGINT + 1)) AS m FROM family WHERE a <> b)
  UNION SELECT road_id, 0.0::DOUBLE FROM plane UNION SELECT road_id, 1.0::DOUBLE FROM plane),
pieces AS (SELECT road_id, t AS t0, lead(t) OVER (PARTITION BY road_id ORDER BY t) AS t1 FROM cuts WHERE t BETWEEN 0 AND 1),
middle AS (
  SELECT road_id, whole * (t1 - t0) AS length_m, degrees((x0 + (x1 - x0) * (t0 + t1) / 2) / {num(KX)}) AS longitude,
    degrees(asin((y0 + (y1 - y0) * (t0 + t1) / 2) / {num(KY)})) AS latitude
  FROM pieces JOIN plane USING (road_id) WHERE t1 IS NOT NULL),
{cells('middle')},
road_cells AS (SELECT road_id, cell, sum(length_m) AS length_m FROM middle_c GROUP BY road_id, cell)"""


def _node(lat: str, lon: str) -> str:
    around = round(360.0 * geo.METERS_PER_DEGREE / reg.ROAD_SNAP_M)
    step = num(360.0 / around)
    return f"(floor(({lat} + 90.0::DOUBLE) / {step} + 0.5::DOUBLE)::BIGINT << 32) + floor(({lon} + 180.0::DOUBLE) / {step} + 0.5::DOUBLE)::BIGINT % {around}"


#: Every walk within reach along the roads, and the shortest for each pair of nodes.
NETWORK = f"""
by_road AS (SELECT road_id, count(*) AS accident_count, sum(severity)::BIGINT AS weight FROM best GROUP BY road_id),
graph AS (
  SELECT road_id, {_node('lat0', 'lon0')} AS u, {_node('lat1', 'lon1')} AS v, {haversine('lat0', 'lon0', 'lat1', 'lon1')} AS len,
    coalesce(accident_count, 0) AS accident_count, coalesce(weight, 0) AS weight
  FROM road LEFT JOIN by_road USING (road_id)),
ways AS (
  SELECT u, v, min(len) AS len FROM (SELECT u, v, len FROM graph UNION ALL SELECT v, u, len FROM graph) WHERE u <> v GROUP BY u, v),
ends AS (
  SELECT road_id, accident_count, weight, u AS node FROM graph UNION ALL SELECT road_id, accident_count, weight, v FROM graph),
weights AS (SELECT node, sum(weight) / 2.0::DOUBLE AS w FROM ends WHERE weight > 0 GROUP BY node),
walks AS (
  SELECT node AS source, node, 0.0::DOUBLE AS d FROM weights
  UNION
  SELECT source, ways.v, d + len FROM walks JOIN ways ON ways.u = walks.node WHERE d + len <= {reg.NETWORK_REACH_M}),
shortest AS (SELECT source, node, min(d) AS d FROM walks GROUP BY source, node),
received AS (
  SELECT s.node, sum(w * (1.0::DOUBLE - d / {num(reg.NETWORK_REACH_M)})) AS got, count(*) AS sources
  FROM shortest s JOIN weights ON weights.node = s.source GROUP BY s.node)"""

#: Density clusters over sites, by all pairs of sites.
BUFFERED = f"""
at_site AS (
  SELECT *, floor((latitude + 90.0::DOUBLE) * 10000 + 0.5::DOUBLE)::BIGINT * 3600000
    + floor((longitude + 180.0::DOUBLE) * 10000 + 0.5::DOUBLE)::BIGINT % 3600000 AS site FROM inc),
site AS (
  SELECT site, count(*) AS n, site // 3600000 / 10000.0::DOUBLE - 90.0::DOUBLE AS slat, site % 3600000 / 10000.0::DOUBLE - 180.0::DOUBLE AS slon
  FROM at_site GROUP BY site),
close AS MATERIALIZED (
  SELECT * FROM (SELECT a.site AS a, b.site AS b, b.n, {haversine('a.slat', 'a.slon', 'b.slat', 'b.slon')} AS d
    FROM site a JOIN site b ON abs(a.slat - b.slat) < 0.01 AND abs(a.slon - b.slon) < 0.01) WHERE d <= 500),
core AS MATERIALIZED (SELECT a AS site FROM close GROUP BY a HAVING sum(n) >= 5),
linked AS MATERIALIZED (SELECT a, b FROM close WHERE a IN (SELECT site FROM core) AND b IN (SELECT site FROM core)),
reached AS (SELECT site AS a, site AS b FROM core UNION SELECT reached.a, linked.b FROM reached JOIN linked ON linked.a = reached.b),
named AS (SELECT a AS site, min(b) AS hotspot FROM reached GROUP BY a),
member AS (
  SELECT site, hotspot, true AS is_core FROM named
  UNION ALL
  SELECT a, hotspot, false FROM (
    SELECT a, hotspot, row_number() OVER (PARTITION BY a ORDER BY d, hotspot) AS rn FROM close JOIN named ON named.site = b
    WHERE a NOT IN (SELECT site FROM core)) WHERE rn = 1)"""

#: First copies by batch of arrival: the mark, what is late, and the ids that are still remembered.
TIMELY = f"""
arrival AS (
  SELECT accident_id, l_linenumber AS report_line, l_shipdate AS shipped,
    dense_rank() OVER (ORDER BY year(l_shipdate::DATE + (l_partkey % {reg.REPORT_LAG_DAYS})::INTEGER)) AS batch
  FROM raw JOIN lineitem ON l_orderkey = event_id),
marks AS (
  SELECT batch, max(max(shipped)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    - INTERVAL {reg.REPORT_BOUND.days} DAY AS mark FROM arrival GROUP BY batch),
judged AS (SELECT a.*, mark, coalesce(shipped < mark, false) AS late FROM arrival a JOIN marks USING (batch)),
offered AS (
  SELECT *, row_number() OVER (PARTITION BY accident_id ORDER BY batch) AS k FROM (
    SELECT *, row_number() OVER (PARTITION BY accident_id, batch ORDER BY shipped, report_line) AS rn FROM judged WHERE NOT late) WHERE rn = 1),
steps AS (
  SELECT accident_id, report_line, k, true AS leaves, shipped AS since FROM offered WHERE k = 1
  UNION ALL
  SELECT o.accident_id, o.report_line, o.k, s.since < o.mark, CASE WHEN s.since < o.mark THEN o.shipped ELSE s.since END
  FROM steps s JOIN offered o ON o.accident_id = s.accident_id AND o.k = s.k + 1)"""


def advice_list(items: list[tuple[str, str]], separator: str, default: str | None = None) -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN {text} END" for cond, text in items)
    joined = f"concat_ws('{separator}', {parts})"
    if default is None:
        return joined
    return f"CASE WHEN {joined} = '' THEN '{default}' ELSE {joined} END"


def level(score: str) -> str:
    return (
        f"CASE WHEN {score} < 1.5 THEN 'LOW' WHEN {score} < 2.2 THEN 'MEDIUM' "
        f"WHEN {score} < 2.7 THEN 'HIGH' ELSE 'CRITICAL' END"
    )


def lift(name: str, value: str, exposed: str, baseline: str) -> str:
    return f"""SELECT '{name}' AS comparison, count(*) FILTER (WHERE {exposed}) AS exposed_n,
  count(*) FILTER (WHERE {baseline}) AS baseline_n,
  round(avg({value}) FILTER (WHERE {exposed}) / avg({value}) FILTER (WHERE {baseline}), 6) AS relative_risk FROM inc"""


def rate_lift(name: str, exposed: str, spans: tuple[float, float]) -> str:
    return f"""SELECT '{name}' AS comparison, count(*) FILTER (WHERE {exposed}) AS exposed_n,
  count(*) FILTER (WHERE NOT ({exposed})) AS baseline_n,
  round((count(*) FILTER (WHERE {exposed}) / {spans[0]}::DOUBLE)
    / (count(*) FILTER (WHERE NOT ({exposed})) / {spans[1]}::DOUBLE), 6) AS relative_risk FROM inc"""


def synthetic_sql() -> str:
    """The sample generator: the same digests, bounds and categories."""

    def draw(digest: str, index: int) -> str:
        word = f"substr({digest}, {index * synthetic.DRAW_HEX + 1}, {synthetic.DRAW_HEX})"
        return f"(CAST('0x' || {word} AS BIGINT) / {num(float(1 << 32))})"

    def pick(u: str, names: list, weights: list[float]) -> str:
        text = [f"'{n}'" if isinstance(n, str) else (num(n) if isinstance(n, float) else str(n)) for n in names]
        whens = " ".join(
            f"WHEN {u} < {num(b)} THEN {t}" for b, t in zip(synthetic.cumulative(weights), text)
        )
        return f"CASE {whens} ELSE {text[-1]} END"

    def poisson(u: str) -> str:
        by_mean = [
            " + ".join(f"CAST({u} >= {num(b)} AS INTEGER)" for b in synthetic.poisson_bounds(m))
            for m in (1, 2, 3)
        ]
        return f"CASE severity WHEN 1 THEN {by_mean[0]} WHEN 2 THEN {by_mean[1]} ELSE {by_mean[2]} END"

    names = list(fixed.CITY_CENTRES)
    lats = [fixed.CITY_CENTRES[c][0] for c in names]
    lons = [fixed.CITY_CENTRES[c][1] for c in names]
    a = [draw("ha", k) for k in range(8)]
    b = [draw("hb", k) for k in range(8)]

    def by_city(values: list) -> str:
        items = ", ".join(f"'{v}'" if isinstance(v, str) else num(v) for v in values)
        return f"[{items}][CAST(floor({a[0]} * {len(names)}) AS INTEGER) + 1]"

    seed, off = fixed.SAMPLE_SEED, num(fixed.SAMPLE_OFFSET_DEGREES)
    return f"""WITH ids AS (SELECT event_id, sha256('{seed}:a:' || event_id) AS ha, sha256('{seed}:b:' || event_id) AS hb
  FROM events),
drawn AS (SELECT *, {by_city(names)} AS city,
  round({by_city(lats)} + ({a[1]} * 2.0 - 1.0) * {off}, 6) AS latitude,
  round({by_city(lons)} + ({a[2]} * 2.0 - 1.0) * {off}, 6) AS longitude,
  DATE '{fixed.SAMPLE_START}' + CAST(floor({a[3]} * {fixed.SAMPLE_DAYS}) AS INTEGER) AS date,
  {pick(a[4], list(range(24)), fixed.HOUR_WEIGHTS)} AS hour,
  CAST(floor({a[5]} * 60) AS INTEGER) AS mi, CAST(floor({a[6]} * 60) AS INTEGER) AS se,
  {pick(a[7], [1, 2, 3], fixed.SEVERITY_WEIGHTS)} AS severity,
  {pick(b[0], fixed.VEHICLE_TYPES, fixed.VEHICLE_WEIGHTS)} AS vehicle_type,
  {pick(b[1], fixed.ROAD_TYPES, fixed.ROAD_WEIGHTS)} AS road_type,
  {pick(b[2], fixed.WEATHER_TYPES, fixed.WEATHER_WEIGHTS)} AS weather FROM ids)
SELECT format('ACC_{{:06d}}', event_id + 1) AS accident_id, city, {_case('city', fixed.CITY_STATES)} AS state,
  latitude, longitude,
  CAST(strftime(date, '%Y-%m-%d') || ' ' || format('{{:02d}}:{{:02d}}:{{:02d}}', hour, mi, se) AS TIMESTAMP)
    AS accident_datetime,
  date, format('{{:02d}}:{{:02d}}:{{:02d}}', hour, mi, se) AS time, hour,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
  CAST(year(date) AS INTEGER) AS year, severity, {_case('severity', fixed.SEVERITY_LABELS)} AS severity_label,
  vehicle_type, road_type, weather, {poisson(b[3])} AS casualties,
  CASE WHEN severity = 3 OR {b[4]} < {num(fixed.SAMPLE_MINOR_FATALITY_RATE)} THEN 1 ELSE 0 END AS fatalities,
  greatest(0, {poisson(b[5])} - CASE WHEN severity = 3 THEN 1 ELSE 0 END) AS injured
FROM drawn"""


def insight_sql() -> str:
    hour, cities = fixed.INSIGHT_HOUR, fixed.INSIGHT_CITIES
    vehicles, weather = fixed.INSIGHT_VEHICLES, fixed.INSIGHT_WEATHER

    def message(text: str, *values: str) -> str:
        pieces = text.replace("%d", "%s").split("%s")
        out = f"'{pieces[0]}'"
        for value, piece in zip(values, pieces[1:]):
            out += f" || {value} || '{piece}'"
        return out

    return fact(
        f"""SELECT '{hour[0]}' AS title, {message(hour[1], 'hour', 'n')} AS message, '{hour[2]}' AS priority
  FROM (SELECT hour, count(*) AS n FROM inc GROUP BY hour ORDER BY n DESC, hour LIMIT 1)
UNION ALL SELECT '{cities[0]}', {message(cities[1], "string_agg(city, ', ' ORDER BY n DESC, city)")}, '{cities[2]}'
  FROM (SELECT city, count(*) AS n FROM inc WHERE severity = 3 GROUP BY city ORDER BY n DESC, city LIMIT 3)
  HAVING count(*) > 0
UNION ALL SELECT '{vehicles[0]}', {message(vehicles[1], "string_agg(vehicle_type, ' and ' ORDER BY s DESC, vehicle_type)")},
  '{vehicles[2]}'
  FROM (SELECT vehicle_type, {AVG_SEV} AS s FROM inc GROUP BY vehicle_type ORDER BY s DESC, vehicle_type LIMIT 2)
UNION ALL SELECT '{weather[0]}', {message(weather[1], 'weather')}, '{weather[2]}'
  FROM (SELECT weather, count(*) AS n, count(*) OVER () AS kinds FROM inc GROUP BY weather
        ORDER BY n DESC, weather LIMIT 1) WHERE kinds > 1"""
    )


def city_report_sql() -> str:
    def top(column: str, score: str, name: str) -> str:
        return f"""{name} AS (SELECT city, {column} AS {name}_value FROM (
  SELECT city, {column}, row_number() OVER (PARTITION BY city ORDER BY {score} DESC, {column}) AS rn
  FROM inc GROUP BY city, {column}) WHERE rn = 1)"""

    before, after = fixed.CITY_RUSH.split("%d")
    recs = advice_list(
        [
            ("fatality_rate > 5", f"'{fixed.CITY_FATALITY}'"),
            ("avg_severity > 2.0", f"'{fixed.CITY_SEVERITY}'"),
            (
                "peak_value BETWEEN 7 AND 10 OR peak_value BETWEEN 17 AND 20",
                f"'{before}' || peak_value || '{after}'",
            ),
        ],
        " | ",
    )
    return fact(
        f"""SELECT city, total_accidents, fatal_accidents, avg_severity, total_casualties, fatality_rate,
  peak_value AS peak_accident_hour, road_value AS riskiest_road_type, vehicle_value AS riskiest_vehicle_type,
  {recs} AS recommendations, seasonal_pattern, top_hotspots
FROM base JOIN peak USING (city) JOIN road USING (city) JOIN vehicle USING (city)
JOIN months USING (city) JOIN spots USING (city)""",
        f"""base AS (SELECT city, count(*) AS total_accidents, count(*) FILTER (WHERE severity = 3) AS fatal_accidents,
  {AVG_SEV} AS avg_severity, {total('casualties')} AS total_casualties,
  CAST(sum(fatalities) AS DOUBLE) * 100.0::DOUBLE / count(*) AS fatality_rate FROM inc GROUP BY city)""",
        top("hour", "count(*)", "peak"),
        top("road_type", AVG_SEV, "road"),
        top("vehicle_type", AVG_SEV, "vehicle"),
        """months AS (SELECT city, string_agg(month || ':' || n, ',' ORDER BY month) AS seasonal_pattern
  FROM (SELECT city, month, count(*) AS n FROM inc GROUP BY city, month) GROUP BY city)""",
        """spots AS (SELECT city, string_agg(cell || ':' || n, ',' ORDER BY rn) AS top_hotspots FROM (
  SELECT city, cell, count(*) AS n, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, cell) AS rn
  FROM inc GROUP BY city, cell) WHERE rn <= 5 GROUP BY city)""",
    )


def report_sql() -> str:
    return fact(
        """SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM (
  SELECT CASE c WHEN 0 THEN 'Minor' WHEN 1 THEN 'Serious' ELSE 'Fatal' END AS class, precision, recall, f1, support
  FROM scored
  UNION ALL SELECT 'accuracy', acc, acc, acc, s FROM (
    SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS acc, CAST(sum(support) AS BIGINT) AS s FROM scored)
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scored
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
    sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scored)""",
        """guess AS (SELECT severity - 1 AS l, CASE WHEN casualties >= 4 THEN 2 WHEN casualties >= 3 THEN 1 ELSE 0 END AS p
  FROM inc)""",
        """sides AS (SELECT c, (SELECT count(*) FROM guess WHERE l = c) AS support,
    (SELECT count(*) FROM guess WHERE p = c) AS predicted, (SELECT count(*) FROM guess WHERE l = c AND p = c) AS hits
  FROM (SELECT DISTINCT l AS c FROM guess UNION SELECT DISTINCT p FROM guess))""",
        """scored AS (SELECT c, support, hits, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE hits / support::DOUBLE END AS recall,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2.0 * hits / (predicted + support)::DOUBLE END AS f1 FROM sides)""",
    )


VIOLATIONS = (
    "concat_ws(' | ', "
    + ", ".join(
        [
            "CASE WHEN accident_id IS NULL THEN 'accident_id_missing' END",
            *[
                f"CASE WHEN {c} IS NULL THEN '{c}_missing' END"
                for c in ("city", "state", "latitude", "longitude", "accident_datetime", "date", "time")
            ],
            *[
                f"CASE WHEN {c} NOT BETWEEN {lo} AND {hi} THEN '{c}_range' END"
                for c, lo, hi in (
                    ("hour", 0, 23), ("day_of_week", 0, 6), ("month", 1, 12), ("year", 2000, 2030),
                )
            ],
            "CASE WHEN severity NOT IN (1, 2, 3) THEN 'severity_value' END",
        ]
    )
    + ")"
)


def statements() -> dict[str, str]:
    lat, lon, reach = reg.RADIUS_CENTER
    out: dict[str, str] = {}

    # sources and sinks
    out["csv_roundtrip"] = fact(f"SELECT {COLUMNS} FROM inc")
    q = f"((cell // {SPAN}) % {SPAN} - {SHIFT})"
    r = f"(cell % {SPAN} - {SHIFT})"
    out["cell_assign"] = fact(
        f"SELECT accident_id, cell, '{RES}:' || {q} || ':' || {r} AS cell_name, "
        "longitude AS geom_lon, latitude AS geom_lat FROM inc"
    )
    out["ml_base"] = fact(
        "SELECT accident_id, city, state, latitude, longitude, hour, day_of_week, month, year, severity, "
        "vehicle_type, road_type, weather, casualties, fatalities, injured, cell FROM inc"
    )
    out["recent_scan"] = fact(f"SELECT {COLUMNS}, cell FROM inc ORDER BY accident_datetime DESC, accident_id")
    out["results_roundtrip"] = fact(
        """SELECT 'accident_clusters' AS table_name, count(*) AS row_count FROM clusters
UNION ALL SELECT 'rush_hour_patterns', count(*) FROM (SELECT DISTINCT city, hour FROM inc)
UNION ALL SELECT 'seasonal_patterns', count(*) FROM (SELECT DISTINCT city, month, year FROM inc)
UNION ALL SELECT 'road_risk_scores', count(*) FROM risk
UNION ALL SELECT 'grid_hotspots', count(*) FROM (SELECT 1 FROM inc
  GROUP BY city, round(latitude * 100), round(longitude * 100) HAVING count(*) >= 5)
UNION ALL SELECT 'analysis_summary', 1 + count(DISTINCT city) FROM inc""",
        CLUSTERS, RISK,
    )
    scored = "SELECT city, road_type, vehicle_type, weather, accident_count, avg_severity, total_fatalities, risk_score"
    out["results_refresh"] = fact(
        f"{scored}, 'after' AS version FROM risk UNION ALL {scored}, 'before' FROM mild",
        RISK, RISK.replace("risk AS", "mild AS", 1).replace("FROM inc", "FROM inc WHERE severity < 3"),
    )
    out["synthetic_incidents"] = synthetic_sql()
    out["city_state_lookup"] = fact(
        "SELECT accident_id, city, "
        f"CASE WHEN state IN ({quoted(reg.KNOWN_REGIONS)}) THEN state ELSE 'Unknown' END AS state FROM inc"
    )
    out["roads_from_geojson"] = f"""WITH {ROADS} SELECT road_id, city, highway, false AS oneway, lat0, lon0, lat1, lon1,
  CAST(CAST(round({haversine('lat0', 'lon0', 'lat1', 'lon1')} / 1000.0, 3) AS DECIMAL(10,3)) AS DOUBLE) AS length_km
FROM road"""
    out["multi_file_csv"] = fact(
        f"SELECT 'dataset=accidents_' || year AS dataset, count(*) AS accident_count, "
        f"{total('casualties')} AS total_casualties, min(year) AS first_year, max(year) AS last_year "
        "FROM inc GROUP BY year"
    )
    micro = "CAST(floor({0} * 1000000 + 0.5::DOUBLE) AS BIGINT)"

    def degrees_text(column: str) -> str:
        e6 = micro.format(column)
        return f"CAST(CAST({e6} AS DECIMAL(18,0)) * CAST('0.000001' AS DECIMAL(7,6)) AS DECIMAL(18,6))"

    out["centroid_wkt"] = fact(
        f"SELECT cell, city, state, 'POINT (' || {degrees_text('center_lon')} || ' ' || "
        f"{degrees_text('center_lat')} || ')' AS cluster_center_wkt FROM clusters",
        CLUSTERS,
    )
    dates = f"date BETWEEN DATE '{reg.DATES[0]}' AND DATE '{reg.DATES[1]}'"
    severities = f"severity_label IN ({quoted(reg.SEVERITIES)})"
    vehicles = f"vehicle_type IN ({quoted(reg.VEHICLES)})"
    out["export_csv"] = fact(f"SELECT {COLUMNS} FROM inc WHERE {dates} AND {severities}")
    out["export_json"] = out["export_csv"]
    out["source_manifest"] = " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, CAST(1 AS BIGINT) AS files, count(*) AS rows FROM {t}"
        for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")
    )

    # quality
    reports = (
        "rep AS (SELECT raw.*, l_shipdate AS reported_at, l_linenumber AS report_line, l_partkey AS report_ref "
        "FROM raw JOIN lineitem ON l_orderkey = event_id)"
    )
    out["ingest_job"] = fact(
        """SELECT 'fact' AS target, '' AS reason, count(DISTINCT accident_id) AS row_count FROM checked WHERE reason = ''
UNION ALL SELECT 'quarantine', reason, count(*) FROM checked WHERE reason <> '' GROUP BY reason
UNION ALL SELECT 'quarantine', 'accident_id_duplicate', count(*) - count(DISTINCT accident_id) FROM checked
  WHERE reason = '' HAVING count(*) > count(DISTINCT accident_id)""",
        reports, f"checked AS (SELECT accident_id, {VIOLATIONS} AS reason FROM rep)",
    )
    out["append_ingest"] = fact(
        """SELECT accident_id, batch, 'fact' AS target, '' AS reason, 1::BIGINT AS row_count FROM entered
UNION ALL SELECT accident_id, batch, 'quarantine', reason, count(*) FROM checked WHERE reason <> '' GROUP BY accident_id, batch, reason
UNION ALL SELECT accident_id, s.batch, 'quarantine',
  CASE WHEN s.batch = e.batch THEN 'accident_id_duplicate' ELSE 'accident_id_known' END, CASE WHEN s.batch = e.batch THEN n - 1 ELSE n END
  FROM sound s JOIN entered e USING (accident_id) WHERE s.batch <> e.batch OR n > 1""",
        reports,
        f"checked AS (SELECT accident_id, {VIOLATIONS} AS reason, "
        f"CASE WHEN reported_at <= DATE '{reg.APPEND_UNTIL}' THEN 1::BIGINT ELSE 2 END AS batch FROM rep)",
        "sound AS (SELECT accident_id, batch, count(*) AS n FROM checked WHERE reason = '' GROUP BY accident_id, batch)",
        "entered AS (SELECT accident_id, min(batch) AS batch FROM sound GROUP BY accident_id)",
    )
    out["csv_quarantine"] = fact(
        f"""SELECT accident_id, CASE WHEN severity = 3 OR {VIOLATIONS} <> '' THEN 'quarantine' ELSE 'fact' END AS target,
  CASE WHEN severity = 3 THEN 'unparsable' ELSE {VIOLATIONS} END AS reason FROM inc"""
    )
    out["dq_duplicates"] = fact(
        "SELECT accident_id, count(*) AS copies, max(reported_at) AS kept_at FROM rep "
        "GROUP BY accident_id HAVING count(*) > 1",
        reports,
    )
    out["dq_deduplicated"] = fact(
        "SELECT accident_id, CAST(1 AS BIGINT) AS kept, max(reported_at) AS kept_at, count(*) - 1 AS surplus "
        "FROM rep GROUP BY accident_id",
        reports,
    )
    out["dq_violations"] = fact(
        f"SELECT accident_id, year, {VIOLATIONS} AS reasons FROM inc WHERE {VIOLATIONS} <> ''"
    )
    out["dq_valid"] = fact(f"SELECT accident_id, year FROM inc WHERE {VIOLATIONS} = ''")
    bad = (
        "concat_ws(' | ', CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range' END, "
        "CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude_range' END, "
        "CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 'hour_range' END)"
    )
    out["dq_requests"] = f"WITH {REQUESTS} SELECT request_id, {bad} AS reasons, {bad} = '' AS is_valid FROM req"
    out["dq_defaults"] = f"WITH {REQUESTS} SELECT request_id, coalesce(weather, 'Clear') AS weather FROM req"

    # filters
    out["filter_incidents"] = fact(
        "SELECT accident_id, city, date, severity_label, vehicle_type FROM inc "
        f"WHERE {dates} AND {severities} AND {vehicles}"
    )
    out["filter_options"] = fact(
        """SELECT DISTINCT 'city' AS option, city AS value FROM inc
UNION ALL SELECT DISTINCT 'severity_label', severity_label FROM inc
UNION ALL SELECT DISTINCT 'vehicle_type', vehicle_type FROM inc
UNION ALL SELECT 'min_date', CAST(min(date) AS VARCHAR) FROM inc
UNION ALL SELECT 'max_date', CAST(max(date) AS VARCHAR) FROM inc"""
    )
    out["heatmap_points"] = fact(
        "SELECT accident_id, latitude, longitude, CAST(severity AS DOUBLE) AS weight FROM inc "
        "ORDER BY md5(accident_id), accident_id LIMIT 5000"
    )

    # aggregations
    out["spatial_clusters"] = fact(
        "SELECT cell, city, state, accident_count, avg_severity, total_casualties, total_fatalities, "
        "earliest_accident, latest_accident, center_lat, center_lon FROM clusters",
        CLUSTERS,
    )
    out["hotspot_view"] = out["hotspot_refresh"] = fact(HOTSPOT_VIEW, CLUSTERS)
    out["cluster_preview"] = fact(
        f"SELECT city, accident_count, avg_severity, total_fatalities FROM clusters WHERE city = '{reg.CITY}' "
        "ORDER BY accident_count DESC, cell, city, state LIMIT 10",
        CLUSTERS,
    )
    rush = f"SELECT city, hour, count(*) AS accident_count, {AVG_SEV} AS avg_severity, "
    out["rush_hour"] = fact(f"{rush}{SPARK_CATEGORY} AS time_category FROM inc GROUP BY city, hour")
    literal = SPARK_CATEGORY.replace("hour >= 21 OR hour <= 5", "hour BETWEEN 21 AND 5")
    out["rush_hour_strict"] = fact(f"{rush}{literal} AS time_category FROM inc GROUP BY city, hour")
    out["seasonal"] = fact(
        f"SELECT city, month, year, count(*) AS accident_count, {AVG_SEV} AS avg_severity, {SEASON} AS season "
        "FROM inc GROUP BY city, month, year"
    )
    out["temporal_view"] = fact(
        f"SELECT city, hour, day_of_week, month, count(*) AS accident_count, {AVG_SEV} AS avg_severity, "
        f"CASE WHEN {WEEKEND} THEN 'Weekend' ELSE 'Weekday' END AS day_type, {WAREHOUSE_CATEGORY} AS time_category "
        "FROM inc GROUP BY city, hour, day_of_week, month"
    )
    out["road_risk"] = fact("SELECT * FROM risk", RISK)
    out["grid_hotspots"] = fact(
        f"SELECT city, {AVG_LAT} AS center_lat, {AVG_LON} AS center_lon, count(*) AS max_nearby_accidents, "
        f"{AVG_SEV} AS hotspot_severity, count(*) FILTER (WHERE severity = 3) AS total_fatal_accidents, "
        "1 AS hotspot_intensity FROM inc "
        "GROUP BY city, round(latitude * 100), round(longitude * 100) HAVING count(*) >= 5"
    )
    out["severity_view"] = fact(
        "SELECT city, state, vehicle_type, road_type, weather, count(*) AS total_accidents, "
        "count(*) FILTER (WHERE severity = 1) AS minor_accidents, "
        "count(*) FILTER (WHERE severity = 2) AS serious_accidents, "
        "count(*) FILTER (WHERE severity = 3) AS fatal_accidents, "
        f"{round2(AVG_SEV)} AS avg_severity, {total('casualties')} AS total_casualties, "
        f"{total('fatalities')} AS total_fatalities FROM inc GROUP BY city, state, vehicle_type, road_type, weather"
    )
    out["global_stats"] = fact(
        "SELECT count(*) AS total_accidents, count(*) FILTER (WHERE severity = 3) AS fatal_accidents, "
        f"{AVG_SEV} AS avg_severity, count(DISTINCT city) AS cities_covered, min(date) AS start_date, "
        "max(date) AS end_date FROM inc"
    )
    out["temporal_hourly"] = temporal("hour")
    out["temporal_daily"] = temporal("day_of_week")
    out["temporal_monthly"] = temporal("month", f"WHERE city = '{reg.CITY}'")
    out["risk_factors"] = fact(
        " UNION ALL ".join(
            f"SELECT '{c}' AS factor, {c} AS value, count(*) AS accident_count, {AVG_SEV} AS avg_severity, "
            f"{total('fatalities')} AS total_fatalities FROM inc GROUP BY {c}"
            for c in ("vehicle_type", "road_type", "weather")
        )
    )
    out["cities"] = fact(
        f"SELECT city, state, count(*) AS accident_count, {AVG_SEV} AS avg_severity, "
        "count(*) OVER () AS total_cities FROM inc GROUP BY city, state"
    )
    out["overview_kpis"] = fact(
        "SELECT count(*) AS total_accidents, "
        f"count(*) FILTER (WHERE accident_datetime > TIMESTAMP '{reg.AS_OF}' - INTERVAL 30 DAYS) AS recent_accidents, "
        "count(*) FILTER (WHERE severity = 3) AS fatal_accidents, "
        "count(*) FILTER (WHERE severity = 3) * 100.0::DOUBLE / count(*) AS fatal_percent, "
        "count(DISTINCT city) AS cities, count(DISTINCT state) AS states, "
        f"{AVG_SEV} AS avg_severity, {total('casualties')} AS total_casualties, "
        f"{total('fatalities')} AS total_fatalities FROM inc"
    )
    out["hourly_counts"] = fact("SELECT hour, count(*) AS count FROM inc GROUP BY hour")
    out["monthly_trend"] = fact(
        "SELECT year, month, count(*) AS count, make_date(year, month, 1) AS date FROM inc GROUP BY year, month"
    )
    out["severity_distribution"] = fact("SELECT severity_label, count(*) AS count FROM inc GROUP BY severity_label")
    out["vehicle_severity_pivot"] = fact(
        "SELECT vehicle_type, "
        + ", ".join(
            f'count(*) FILTER (WHERE severity_label = \'{s}\') AS "{s}"' for s in fixed.SEVERITY_LABELS.values()
        )
        + " FROM inc GROUP BY vehicle_type"
    )
    out["city_comparison"] = fact(
        f"SELECT city, count(*) AS total_accidents, {bround2(AVG_SEV)} AS avg_severity, "
        f"{total('fatalities')} AS total_fatalities, {total('casualties')} AS total_casualties FROM inc "
        "GROUP BY city ORDER BY total_accidents DESC, city LIMIT 10"
    )
    out["cell_top5"] = fact(
        f"SELECT cell, count(*) AS accidents, {bround2(AVG_SEV)} AS avg_severity FROM inc GROUP BY cell "
        "ORDER BY accidents DESC, cell LIMIT 5"
    )
    out["rush_rollup"] = fact(
        f"SELECT {SPARK_CATEGORY} AS time_category, count(*) AS accident_count FROM inc GROUP BY 1"
    )
    out["season_rollup"] = fact(f"SELECT {SEASON} AS season, count(*) AS accident_count FROM inc GROUP BY 1")
    for name, column in (("risk_by_road", "road_type"), ("risk_by_weather", "weather")):
        out[name] = fact(
            f"SELECT {column}, CAST(sum(CAST(round(risk_score * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0::DOUBLE "
            f"AS risk_score FROM risk GROUP BY {column}",
            RISK,
        )
    out["risk_metrics"] = fact(
        f"SELECT CAST(sum(fatalities) FILTER (WHERE {vehicles}) AS DOUBLE) * 100.0::DOUBLE "
        f"/ count(*) FILTER (WHERE {vehicles}) AS fatality_rate, "
        f"CAST(sum(casualties) FILTER (WHERE {vehicles}) AS DOUBLE) / count(*) FILTER (WHERE {vehicles}) "
        "AS avg_casualties, CAST(sum(casualties) AS DOUBLE) / count(*) AS overall_avg_casualties, "
        f"count(*) FILTER (WHERE {vehicles} AND severity >= 2) * 100.0::DOUBLE "
        f"/ count(*) FILTER (WHERE {vehicles}) AS high_severity_rate FROM inc"
    )
    infra = advice_list(
        [
            ("avg_severity > 2", f"'{fixed.INFRA_CAMERAS}'"),
            ("road_type = 'Highway'", f"'{fixed.INFRA_BARRIERS}'"),
            ("fatalities > 0", f"'{fixed.INFRA_EMERGENCY}'"),
            ("accident_count > 10", f"'{fixed.INFRA_SIGNALS}'"),
        ],
        ", ",
    )
    out["infrastructure_recs"] = fact(
        f"SELECT *, {infra} AS recommendations FROM (SELECT city, road_type, count(*) AS accident_count, "
        f"{AVG_SEV} AS avg_severity, {total('fatalities')} AS fatalities FROM inc GROUP BY city, road_type "
        "ORDER BY accident_count DESC, city, road_type LIMIT 5)"
    )
    out["city_report"] = city_report_sql()
    out["city_month_counts"] = fact("SELECT city, month, count(*) AS accident_count FROM inc GROUP BY city, month")
    out["city_top_cells"] = fact(
        f"""SELECT * FROM (SELECT city, cell, count(*) AS accident_count, {AVG_LAT} AS latitude, {AVG_LON} AS longitude,
  {AVG_SEV} AS avg_severity,
  CAST(row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, cell) AS INTEGER) AS position
  FROM inc GROUP BY city, cell) WHERE position <= 5"""
    )
    out["city_stats"] = fact(
        f"SELECT city, {AVG_SEV} AS city_avg_severity, round(stddev_samp(severity), 6) AS city_severity_std, "
        "CAST(sum(casualties) AS DOUBLE) / count(*) AS city_avg_casualties FROM inc GROUP BY city"
    )
    out["cell_profile"] = fact(
        f"""SELECT cell, accident_count, avg_severity, total_fatalities, total_casualties, mh_value AS common_hour,
  mv_value AS common_vehicle, mr_value AS common_road, center_lat, center_lon,
  CASE WHEN accident_count >= (SELECT quantile_cont(accident_count, 0.8) FROM base) THEN 1 ELSE 0 END AS is_hotspot,
  accident_count::DOUBLE / (SELECT max(accident_count) FROM base) AS density_score,
  avg_severity * total_fatalities AS severity_risk
FROM base JOIN mh USING (cell) JOIN mv USING (cell) JOIN mr USING (cell)""",
        f"""base AS (SELECT cell, count(*) AS accident_count, {AVG_SEV} AS avg_severity,
  {total('fatalities')} AS total_fatalities, {total('casualties')} AS total_casualties,
  {AVG_LAT} AS center_lat, {AVG_LON} AS center_lon FROM inc GROUP BY cell)""",
        mode_of("hour", "mh"), mode_of("vehicle_type", "mv"), mode_of("road_type", "mr"),
    )
    out["insights"] = insight_sql()
    out["hourly_city_stats"] = fact(
        f"SELECT hour, city, count(*) AS accident_count, {AVG_SEV} AS avg_severity FROM inc GROUP BY hour, city"
    )
    severe, fatal = "CAST(severity >= 2 AS INTEGER)", "CAST(severity = 3 AS INTEGER)"
    out["relative_risk"] = fact(
        " UNION ALL ".join(
            [
                rate_lift("peak_hour_rate", IS_RUSH, (8.0, 16.0)),
                rate_lift("monsoon_rate", "month IN (6, 7, 8, 9)", (4.0, 8.0)),
                lift("weekend_severe", severe, WEEKEND, f"NOT ({WEEKEND})"),
                lift("highway_fatal", fatal, "road_type = 'Highway'", "road_type = 'City Road'"),
                lift("motorcycle_severity", "severity", "vehicle_type = 'Motorcycle'", "vehicle_type = 'Car'"),
                lift("night_fatal", fatal, IS_NIGHT, f"NOT {IS_NIGHT}"),
                lift("rain_severe", severe, "weather = 'Rain'", "weather = 'Clear'"),
            ]
        )
    )
    figures = (
        f"{AVG_SEV} AS avg_severity, {total('fatalities')} AS total_fatalities, "
        f"{total('casualties')} AS total_casualties, min(date) AS analysis_start_date, max(date) AS analysis_end_date"
    )
    out["insights_summary"] = fact(
        "SELECT 'Total Analysis' AS category, count(*) AS total_accidents, count(DISTINCT city) AS cities_covered, "
        f"{figures} FROM inc UNION ALL SELECT 'City: ' || city, count(*), count(DISTINCT road_type), {figures} "
        "FROM inc GROUP BY city"
    )
    def contents(name: str, keys: str, count: str, mean: str, one: str = "NULL", two: str = "NULL") -> str:
        return (
            f"SELECT '{name}' AS table_name, concat_ws('|', {keys}) AS keys, {count} AS incidents, {mean} AS mean_severity, "
            f"CAST({one} AS DOUBLE) AS figure, CAST({two} AS DOUBLE) AS other_figure FROM "
        )

    out["results_contents"] = (
        contents("accident_clusters", "cell, city, state, earliest_accident, latest_accident", "accident_count", "avg_severity", "center_lat", "center_lon")
        + f"({out['spatial_clusters']}) UNION ALL "
        + contents("rush_hour_patterns", "city, hour, time_category", "accident_count", "avg_severity")
        + f"({out['rush_hour']}) UNION ALL "
        + contents("seasonal_patterns", "city, month, year, season", "accident_count", "avg_severity")
        + f"({out['seasonal']}) UNION ALL "
        + contents("road_risk_scores", "city, road_type, vehicle_type, weather", "accident_count", "avg_severity", "risk_score", "total_fatalities")
        + f"({out['road_risk']}) UNION ALL "
        + contents("grid_hotspots", "city", "max_nearby_accidents", "hotspot_severity", "center_lat", "center_lon")
        + f"({out['grid_hotspots']}) UNION ALL "
        + contents("analysis_summary", "category, analysis_start_date, analysis_end_date", "total_accidents", "avg_severity", "cities_covered", "total_casualties")
        + f"({out['insights_summary']})"
    )
    lat_of = f"degrees(asin({r} * {num(1.5 * EDGE)} * {num(geo.GRID_PARALLEL_COS / geo.GRID_RADIUS_KM)}))"
    lon_of = f"degrees(({q} + {r} / 2.0::DOUBLE) * {num(3.0**0.5 * EDGE)} / {num(KX)})"
    out["top_hotspots"] = fact(
        f"SELECT cell, city, state, round({lat_of}, 6) AS latitude, round({lon_of}, 6) AS longitude, accident_count, "
        "avg_severity, total_casualties, total_fatalities FROM clusters "
        "ORDER BY accident_count DESC, cell, city, state LIMIT 10",
        CLUSTERS,
    )

    # joins
    out["features"] = fact(
        f"""SELECT accident_id, inc.city, state, latitude, longitude, hour, day_of_week, month, year, severity,
  inc.vehicle_type, inc.road_type, weather, casualties, fatalities, injured, inc.cell, {FLAGS},
  cell_density, neighbor_density, city_avg_severity, city_severity_std, city_avg_casualties, road_type_risk,
  vehicle_type_risk
FROM inc JOIN density USING (cell) JOIN by_city USING (city) JOIN by_road USING (road_type)
JOIN by_vehicle USING (vehicle_type)""",
        DENSITY, RATES,
    )
    out["neighbor_density"] = fact("SELECT * FROM density", DENSITY)
    away = haversine(num(lat), num(lon), "latitude", "longitude")
    out["within_radius"] = fact(
        f"SELECT accident_id, city, severity, {round2(away)} AS distance_meters FROM inc WHERE {away} <= {reach}"
    )
    out["sql_within_radius"] = out["within_radius"]
    out["radius_join"] = fact(
        f"""SELECT road_id, count(*) AS accident_count, {AVG_SEV} AS avg_severity,
  count(*) FILTER (WHERE severity = 3) AS fatal_accidents, {round2('min(d)')} AS nearest_meters
FROM (SELECT road_id, severity, {haversine('lat0', 'lon0', 'latitude', 'longitude')} AS d
      FROM inc JOIN road ON abs(lat0 - latitude) < 0.1 AND abs(lon0 - longitude) < 0.1)
WHERE d <= {reg.CENTER_RADIUS_M} GROUP BY road_id""",
        ROADS,
    )
    out["sql_radius_requests"] = fact(
        f"""SELECT request_id, accident_id, city, severity, {round2('d')} AS distance_meters
FROM (SELECT request_id, accident_id, inc.city, inc.severity,
        {haversine('req.latitude', 'req.longitude', 'inc.latitude', 'inc.longitude')} AS d
      FROM inc JOIN req ON abs(req.latitude - inc.latitude) < 0.1 AND abs(req.longitude - inc.longitude) < 0.1
      WHERE req.latitude BETWEEN -90 AND 90 AND req.longitude BETWEEN -180 AND 180)
WHERE d <= {reg.CENTER_RADIUS_M}""",
        REQUESTS,
    )
    out["hotspot_requests"] = fact(
        f"""SELECT request_id, cell, city, accident_count, avg_severity, {round2('d')} AS distance_meters
FROM (SELECT request_id, cell, clusters.city, accident_count, avg_severity,
        {haversine('latitude', 'longitude', 'center_lat', 'center_lon')} AS d
      FROM req JOIN clusters ON abs(center_lat - latitude) < 0.1 AND abs(center_lon - longitude) < 0.1
      WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180)
WHERE d <= {fixed.REQUEST_RADIUS_KM * 1000.0}""",
        CLUSTERS, REQUESTS,
    )
    out["road_match"] = fact(
        f"SELECT accident_id, road_id, {round2('d')} AS distance_meters FROM best", ROADS, segment_distance()
    )
    out["road_line_match"] = fact(
        f"SELECT accident_id, road_id, {round2('d')} AS distance_meters FROM best", ROADS, HALVES, segment_distance("half")
    )
    out["road_segment_risk"] = fact(
        f"""SELECT road_id, count(*) AS accident_count, {AVG_SEV} AS avg_severity,
  {total('fatalities')} AS total_fatalities,
  {round2('CAST(sum(severity) + 3 * sum(fatalities) AS DOUBLE) / count(*)')} AS risk_score
FROM best GROUP BY road_id""",
        ROADS, segment_distance(),
    )
    out["road_cells"] = f"WITH {ROADS}, {ROAD_CELLS} SELECT road_id, cell, round(length_m, 3) AS length_m FROM road_cells"
    out["road_cell_risk"] = fact(
        f"""SELECT cell, road_km, roads, coalesce(n, 0) AS accident_count, avg_severity,
  round(coalesce(n, 0) / nullif(road_km, 0), 6) AS accidents_per_km
FROM (SELECT cell, round(sum(length_m) / 1000.0::DOUBLE, 6) AS road_km, count(*) AS roads FROM road_cells GROUP BY cell)
LEFT JOIN (SELECT cell, count(*) AS n, {AVG_SEV} AS avg_severity FROM inc GROUP BY cell) USING (cell)""",
        ROADS, ROAD_CELLS,
    )
    out["road_network_risk"] = fact(
        """SELECT road_id, accident_count, weight, round(sum(coalesce(got, 0.0::DOUBLE)) / 2.0::DOUBLE, 6) AS network_risk,
  max(coalesce(sources, 0)) AS nodes_in_reach
FROM ends LEFT JOIN received USING (node) GROUP BY road_id, accident_count, weight""",
        ROADS, segment_distance(), NETWORK,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    out["buffered_hotspots"] = fact(
        f"""SELECT hotspot, count(DISTINCT site) AS sites, count(DISTINCT site) FILTER (WHERE is_core) AS core_sites,
  count(*) AS accident_count, {AVG_SEV} AS avg_severity, count(*) FILTER (WHERE severity = 3) AS fatal_accidents,
  round({AVG_LAT}, 9) AS center_lat, round({AVG_LON}, 9) AS center_lon
FROM at_site JOIN member USING (site) GROUP BY hotspot""",
        BUFFERED,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    out["unseen_categories"] = fact(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, coalesce({c}, 'None') AS value, count(*) AS rows FROM req "
            f"WHERE coalesce({c}, 'None') NOT IN (SELECT {c} FROM inc) GROUP BY 2"
            for c in ("city", "vehicle_type", "road_type", "weather")
        ),
        REQUESTS,
    )

    # rules
    out["time_features"] = fact(
        f"SELECT accident_id, {FLAGS}, CASE WHEN {WEEKEND} THEN 'Weekend' ELSE 'Weekday' END AS day_type, "
        f"{SPARK_CATEGORY} AS time_category, {WAREHOUSE_CATEGORY} AS warehouse_category FROM inc"
    )
    out["risk_level"] = fact(
        f"SELECT cell, risk_score, {level('risk_score')} AS risk_level FROM "
        f"(SELECT cell, {AVG_SEV} AS risk_score FROM inc GROUP BY cell)"
    )
    trip = advice_list(
        [
            (f"{level('severity')} IN ('HIGH', 'CRITICAL')", f"'{fixed.TRIP_HIGH_RISK}'"),
            (f"hour IN ({', '.join(map(str, fixed.TRIP_RUSH_HOURS))})", f"'{fixed.TRIP_RUSH}'"),
            ("weather <> 'Clear'", f"'{fixed.TRIP_WEATHER}'"),
            (f"vehicle_type IN ({quoted(fixed.VULNERABLE_VEHICLES)})", f"'{fixed.TRIP_VULNERABLE}'"),
            ("road_type = 'Highway'", f"'{fixed.TRIP_HIGHWAY}'"),
        ],
        " | ",
        fixed.TRIP_DEFAULT,
    )
    out["trip_advice"] = fact(f"SELECT accident_id, {trip} AS advice FROM inc")

    # learning
    seasons = f"labelled AS (SELECT *, {SEASON} AS season FROM inc)"
    out["label_encode"] = fact(labels(reg.LABEL_COLUMNS, "labelled"), seasons)
    out["label_codes"] = fact(
        "SELECT accident_id, c.code AS city_encoded, v.code AS vehicle_type_encoded FROM inc "
        "JOIN codes c ON c.feature = 'city' AND c.value = inc.city "
        "JOIN codes v ON v.feature = 'vehicle_type' AND v.value = inc.vehicle_type",
        f"codes AS ({labels(['city', 'vehicle_type'])})",
    )
    out["standardize"] = fact(
        "SELECT accident_id, "
        + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_z" for c in reg.SCALED)
        + " FROM inc, stats",
        "stats AS (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in reg.SCALED)
        + " FROM inc)",
    )
    out["stratified_split"] = fact(
        "SELECT accident_id, severity, row_number() OVER (PARTITION BY severity ORDER BY md5(accident_id), accident_id) "
        "<= floor(count(*) OVER (PARTITION BY severity) * 0.8::DOUBLE) AS is_train FROM inc"
    )
    sides = (
        "UNION ALL SELECT '{0}', 'train', {1}, floor(count(*) * 0.8::DOUBLE)::BIGINT, 0 FROM {2} GROUP BY 3 "
        "UNION ALL SELECT '{0}', 'test', {1}, count(*) - floor(count(*) * 0.8::DOUBLE)::BIGINT, 0 FROM {2} GROUP BY 3 "
    )
    out["learning_evidence"] = (
        "SELECT subject, part, label, n, unsound FROM ("
        "SELECT 'importance' AS subject, 'all' AS part, 0::BIGINT AS label, 21::BIGINT AS n, 0::BIGINT AS unsound "
        "UNION ALL SELECT 'top features', 'all', 0, 5, 0 "
        f"UNION ALL SELECT 'reload', 'all', 0, count(*), 0 FROM ({fact('SELECT * FROM inc')}) "
        + sides.format("severity", "severity - 1", f"({fact('SELECT * FROM inc')})")
        + sides.format("hotspot", "is_hotspot", f"({out['cell_profile']})")
        + sides.format("casualty", "0", f"({fact('SELECT * FROM inc')})")
        + f"UNION ALL SELECT 'score', CASE WHEN is_valid THEN 'valid' ELSE 'rejected' END, 0, count(*), 0 FROM ({out['dq_requests']}) GROUP BY 2"
        ") WHERE n > 0"
    )
    out["classification_report"] = report_sql()
    out["regression_metrics"] = fact(
        "SELECT count(*) AS n, round(avg(e), 6) AS mse, round(1 - avg(e) / var_pop(casualties), 6) AS r2 FROM "
        "(SELECT casualties, CAST((casualties - severity) * (casualties - severity) AS DOUBLE) AS e FROM inc)"
    )
    out["scoring_features"] = fact(
        f"""SELECT request_id, CAST(coalesce(cell_density, 0) AS BIGINT) AS cell_density,
  round(coalesce(neighbor_density, 0), 6) AS neighbor_density,
  coalesce(city_avg_severity, 2.0) AS city_avg_severity, coalesce(city_severity_std, 0.5) AS city_severity_std,
  coalesce(city_avg_casualties, 1.5) AS city_avg_casualties, coalesce(road_type_risk, 2.0) AS road_type_risk,
  coalesce(vehicle_type_risk, 2.0) AS vehicle_type_risk,
  {int(reg.AS_OF.weekday() in fixed.WEEKEND_DAYS)} AS is_weekend,
  (SELECT {SEASON} FROM (SELECT {reg.AS_OF.month} AS month)) AS season
FROM ok_c LEFT JOIN density USING (cell) LEFT JOIN by_city USING (city) LEFT JOIN by_road USING (road_type)
LEFT JOIN by_vehicle USING (vehicle_type)""",
        DENSITY, RATES, REQUESTS,
        "ok AS (SELECT * FROM req WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 "
        "AND hour BETWEEN 0 AND 23)",
        cells("ok"),
    )

    # streaming
    out["stream_ingest"] = fact(
        f"SELECT accident_id, cell, {VIOLATIONS} = '' AS is_valid, {VIOLATIONS} AS reasons FROM inc"
    )
    out["stream_dedupe"] = fact("SELECT DISTINCT accident_id, city, severity FROM rep", reports)
    out["stream_timely"] = fact(
        """SELECT accident_id, report_line, 'first' AS target FROM steps WHERE leaves
UNION ALL SELECT accident_id, report_line, 'late' FROM judged WHERE late""",
        TIMELY,
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    out["stream_hotspots"] = out["stream_hotspots_folded"] = fact(HOTSPOT_VIEW, CLUSTERS)
    out["stream_daily_cells"] = fact(
        f"SELECT CAST(ts AS DATE) AS day, cell, count(*) AS accident_count, {AVG_SEV} AS avg_severity FROM inc "
        "WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM inc) GROUP BY 1, 2"
    )
    return out
