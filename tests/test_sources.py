import json
import os

import pytest
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.plans import analysis, views
from kerbwise.schema import INCIDENT_COLUMNS, RESULT_TABLES
from kerbwise.session import new_path, shared_folder
from kerbwise.sources import files, results, synthetic
from tests.rows import make

HEADER = ",".join(INCIDENT_COLUMNS)
LINE = (
    "ACC_000001,Pune,Maharashtra,18.5,73.8,2021-03-18 09:30:05,2021-03-18,09:30:05,9,3,3,2021,"
    "2,Serious,Car,Highway,Clear,,0,1"
)


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_with_all_columns(spark, tmp_path):
    row = files.load_incidents(spark, _file(tmp_path, "ok.csv", f"{HEADER}\n{LINE}\n")).first()
    assert (row.time, row.hour, row.day_of_week, row.year, row.severity, row.casualties) == (
        "09:30:05", 9, 3, 2021, 2, 0,
    )
    assert (row.geom.lon, row.geom.lat) == (73.8, 18.5) and row.cell is not None


def test_csv_without_time_fails(spark, tmp_path):
    header = HEADER.replace(",time,", ",")
    line = LINE.replace(",09:30:05,9", ",9")
    path = _file(tmp_path, "bad.csv", f"{header}\n{line}\n")
    with pytest.raises(Exception, match="CSV"):
        files.load_incidents(spark, path).collect()


def test_csvs_carry_their_folder(spark, tmp_path):
    for name in ("accidents_2019", "accidents_2020"):
        os.makedirs(tmp_path / name)
        _file(tmp_path / name, "part.csv", f"{HEADER}\n{LINE}\n")
    rows = files.read_incident_csvs_with_origin(spark, str(tmp_path)).groupBy("dataset").count().collect()
    assert {r.dataset: r["count"] for r in rows} == {"accidents_2019": 1, "accidents_2020": 1}


def _feature(road_id, coordinates, **more):
    return {
        "type": "Feature",
        "properties": {"road_id": road_id, "osmid": 5, "highway": "primary", "city": "Pune", **more},
        "geometry": {"type": "LineString", "coordinates": coordinates},
    }


def test_road_collection_and_lines_agree(spark, tmp_path):
    features = [
        _feature(1, [[73.8, 18.5], [73.81, 18.5], [73.81, 18.51]], oneway=True, lanes=2),
        _feature(2, [[73.8, 18.5]]),
        {"type": "Feature", "properties": {"road_id": 3}, "geometry": {"type": "Point", "coordinates": []}},
    ]
    whole = _file(tmp_path, "roads.geojson", json.dumps({"type": "FeatureCollection", "features": features[:2]}, indent=1))
    lines = _file(tmp_path, "roads.json", "\n".join(json.dumps(f) for f in features[:2]))
    a = files.read_road_collections(spark, whole).orderBy("road_id").collect()
    b = files.read_road_lines(spark, lines).orderBy("road_id").collect()
    assert a == b and len(a) == 2
    assert [r.oneway for r in a] == [True, False] and len(a[0].geometry) == 3
    assert float(a[0].length_km) == pytest.approx(1.055 + 1.112, abs=0.002) and float(a[1].length_km) == 0.0


def test_result_tables(spark, incidents):
    store = results.ResultStore(spark, new_path(spark, "store"))
    empty = store.load_all()
    assert empty.keys() == RESULT_TABLES.keys() and all(df.count() == 0 for df in empty.values())
    stored = analysis.run_complete_analysis(incidents, store)
    for name, lazy in analysis.analyses(incidents).items():
        lazy = results.flatten_points(lazy)
        assert [f.simpleString() for f in lazy.schema] == [f.simpleString() for f in RESULT_TABLES[name]]
        assert stored[name].exceptAll(lazy).count() == 0 and stored[name].count() == lazy.count() > 0
    store.save(stored["rush_hour_patterns"].limit(1), "road_risk_scores")
    assert store.load("road_risk_scores").count() == 1  # replaced


def test_full_analysis_scans_the_fact_once(spark, incidents):
    path = new_path(spark, "fact")
    files.write_incident_table(incidents, path)
    shared = analysis.shared_sums(spark.read.parquet(path))
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_sum" in plan and "SortAggregate" not in plan
    sums = new_path(spark, "shared-sums")
    shared.write.partitionBy("grouping").parquet(sums)
    back = spark.read.schema(shared.schema).parquet(sums)
    for df in analysis.tables_of(back).values():
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") == 1 and "PartitionFilters: [isnotnull(grouping" in text and path not in text
    nothing = spark.createDataFrame([], incidents.schema)
    assert all(r.n == 0 for r in analysis.shared_sums(nothing).collect())


def test_fact_table(spark, incidents):
    path = new_path(spark, "fact")
    files.write_incident_table(incidents, path)
    back = spark.read.parquet(path)
    assert back.select(incidents.columns).exceptAll(incidents).count() == 0 and back.count() == incidents.count()
    assert any(name.startswith("year=") for name in os.listdir(path))
    plan = back.where("year = 1997 AND severity = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(severity,3)" in plan


def test_manifest(spark, incidents):
    a, b = new_path(spark, "m"), new_path(spark, "m")
    incidents.repartition(3).write.parquet(a)
    incidents.limit(5).coalesce(1).write.parquet(b)
    listed = files.manifest(spark, {"a": spark.read.parquet(a), "b": spark.read.parquet(b)})
    got = {r.dataset: (r.files, r["rows"], r.bytes > 0) for r in listed.collect()}
    assert got == {"a": (3, incidents.count(), True), "b": (1, 5, True)}
    out = new_path(spark, "manifest")
    files.write_manifest(listed, out)
    assert spark.read.json(out).count() == 2


def test_states(spark):
    df = spark.createDataFrame([("Pune",), ("Delhi",), ("Atlantis",)], "city string")
    want = {"Pune": "Maharashtra", "Delhi": "Delhi", "Atlantis": "Unknown"}
    assert {r.city: r.state for r in synthetic.with_state(df).collect()} == want
    joined = synthetic.with_state(df, synthetic.city_states(spark))
    assert {r.city: r.state for r in joined.collect()} == want


def test_sample_incidents_follow_their_distributions(spark):
    df = synthetic.sample_incidents(spark, 20000)
    n = df.count()
    assert n == 20000 and df.select("accident_id").distinct().count() == n
    share = {r.severity: r["count"] / n for r in df.groupBy("severity").count().collect()}
    assert share[1] == pytest.approx(0.7, abs=0.02) and share[3] == pytest.approx(0.05, abs=0.01)
    cars = df.where("vehicle_type = 'Car'").count() / n
    assert cars == pytest.approx(0.4, abs=0.02)
    means = {r.severity: r.m for r in df.groupBy("severity").agg(F.avg("casualties").alias("m")).collect()}
    assert means[1] == pytest.approx(1.0, abs=0.05) and means[3] == pytest.approx(3.0, abs=0.25)
    evening = df.where("hour = 18").count() / df.where("hour = 3").count()
    assert 8 < evening < 20
    bad = df.where(
        "hour <> hour(accident_datetime) OR day_of_week <> weekday(date) OR injured < 0 "
        "OR (severity = 3 AND fatalities <> 1) OR state = 'Unknown'"
    )
    assert bad.count() == 0
    centre = F.create_map(*[x for c, (la, _) in fixed.CITY_CENTRES.items() for x in (F.lit(c), F.lit(la))])
    assert df.where(F.abs(F.col("latitude") - centre[F.col("city")]) > 0.1000001).count() == 0


def test_sample_does_not_depend_on_partitions(spark):
    ids = spark.range(500)
    a = synthetic.synthesize(ids.repartition(7), "id")
    b = synthetic.synthesize(ids.coalesce(1), "id")
    assert a.exceptAll(b).count() == 0
    assert synthetic.synthesize(ids, "id", seed=7).exceptAll(b).count() > 400


def test_sql_views_and_radius_function(spark, incidents):
    views.register_views(spark, incidents)
    assert spark.sql("SELECT city, COUNT(*) FROM accidents GROUP BY city ORDER BY COUNT(*) DESC").count() == 25
    top = spark.sql("SELECT * FROM accident_hotspots ORDER BY accident_count DESC LIMIT 10").collect()
    assert top and top[0].accident_count >= 3
    assert spark.sql("SELECT * FROM temporal_patterns").count() > 0
    assert spark.sql("SELECT * FROM severity_analysis").count() > 0
    from kerbwise.operators.radius import within_radius

    got = spark.sql("SELECT * FROM accidents_within_radius(15.0, 75.5, 9000) ORDER BY distance_meters, accident_id").collect()
    assert got == within_radius(incidents, 15.0, 75.5, 9000).collect() and got
    lat, lon = incidents.select("latitude", "longitude").first()
    assert spark.sql(f"SELECT * FROM accidents_within_radius({lat}, {lon})").count() >= 1


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_csv_export(spark, incidents):
    path = new_path(spark, "export")
    files.export_csv(make(spark, {}, {"city": "B"}, cell=False).where("city = 'B'"), path)
    assert files.read_incident_csv(spark, path).count() == 1


def test_ingest_job_accounts_for_every_row(spark, tmp_path):
    from kerbwise.plans.ingest import ingest_csv

    df = make(
        spark, {}, {}, {"hour": 30}, {"accident_id": "ACC_000001", "city": "Other"},
        {"accident_id": "ACC_000001", "city": "Other"}, {"casualties": None}, cell=False,
    )
    raw = new_path(spark, "raw")
    files.write_incident_csv(df, raw)
    facts, rejected = ingest_csv(spark, [raw], new_path(spark, "fact"), new_path(spark, "rejected"))
    assert facts.count() == 3 and facts.where("cell IS NULL OR created_at IS NULL OR casualties IS NULL").count() == 0
    reasons = {r.reasons[0]: r.n for r in rejected.groupBy("reasons").agg(F.sum("copies").alias("n")).collect()}
    assert reasons == {"hour_range": 1, "accident_id_duplicate": 2}


BAD_LINES = [LINE.replace(",2,Serious", ",high,Serious"), "ACC_2,Pune", LINE + ",more"]


def test_lines_that_do_not_parse_are_kept_apart(spark, tmp_path):
    from kerbwise.plans.ingest import ingest_csv

    path = _file(tmp_path, "bad.csv", "\n".join([HEADER, LINE, *BAD_LINES, ""]))
    facts, rejected = ingest_csv(spark, [path], new_path(spark, "fact"), new_path(spark, "rejected"))
    assert facts.count() == 1 and "unparsed" not in facts.columns
    assert sorted(r.unparsed for r in rejected.where("reasons = array('unparsable') AND copies = 1").collect()) == sorted(BAD_LINES)
    assert rejected.count() == 3
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_incident_csv(spark, path).select("accident_id").collect()


def test_many_point_roads(spark):
    from kerbwise.operators.radius import match_roads, segments_of

    lines = spark.createDataFrame(
        [(1, [(73.0, 18.0), (73.01, 18.0), (73.01, 18.02)]), (2, [(74.0, 18.0)]), (3, []), (4, None)],
        "road_id long, geometry array<struct<lon:double,lat:double>>",
    )
    segments = segments_of(lines)
    assert sorted(map(tuple, segments.collect())) == [
        (1, 18.0, 73.0, 18.0, 73.01), (1, 18.0, 73.01, 18.02, 73.01), (2, 18.0, 74.0, 18.0, 74.0),
    ]
    spots = make(spark, {"latitude": 18.015, "longitude": 73.0101}, {"latitude": 18.001, "longitude": 74.0}, {"latitude": 18.02, "longitude": 73.0})
    got = sorted((r.road_id, r.distance_meters) for r in match_roads(spots, segments).collect())
    assert [road for road, _ in got] == [1, 2] and got[0][1] == pytest.approx(10.6, abs=0.2) and got[1][1] == pytest.approx(111.2, abs=0.3)


def test_json_export(spark, incidents):
    from kerbwise.operators.temporal import temporal_analysis

    path = new_path(spark, "json")
    hourly = temporal_analysis(incidents)
    files.export_json(hourly, path)
    assert spark.read.schema(hourly.schema).json(path).exceptAll(hourly).count() == 0
