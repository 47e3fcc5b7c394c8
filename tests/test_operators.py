import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbwise.functions import calendar as cal
from kerbwise.functions import rules
from kerbwise.operators import filters, quality, reports, risk, spatial, summary, temporal
from kerbwise.operators.totals import marginals
from kerbwise.session import written
from tests.rows import make


def hours(spark, windows, **kw):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    rows = df.select("h", cal.time_category(F.col("h"), windows, **kw).alias("c")).collect()
    return {name: [r.h for r in rows if r.c == name] for name in ("Morning Rush", "Evening Rush", "Night")}


def test_hours_of_each_preset(spark):
    assert hours(spark, cal.SPARK_WINDOWS) == {
        "Morning Rush": [7, 8, 9, 10], "Evening Rush": [17, 18, 19, 20], "Night": [0, 1, 2, 3, 4, 5, 21, 22, 23],
    }
    assert hours(spark, cal.WAREHOUSE_WINDOWS) == {
        "Morning Rush": [6, 7, 8, 9, 10], "Evening Rush": [17, 18, 19, 20, 21],
        "Night": [0, 1, 2, 3, 4, 5, 22, 23],
    }
    assert hours(spark, cal.SPARK_WINDOWS, strict_reference=True)["Night"] == []


def test_night_flag_excludes_22(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("h"))
    night = [r.h for r in df.where(cal.is_night(F.col("h"))).collect()]
    assert night == [0, 1, 2, 3, 4, 5, 23]


def test_seasons(spark):
    df = spark.range(1, 14).select(F.col("id").cast("int").alias("m"))
    rows = {r.m: (r.s, r.l) for r in df.select("m", cal.season(F.col("m")).alias("s"), cal.season_or_last(F.col("m")).alias("l")).collect()}
    assert rows[12] == rows[1] == ("Winter", "Winter")
    assert rows[9] == ("Monsoon", "Monsoon") and rows[10] == ("Post-Monsoon", "Post-Monsoon")
    assert rows[13] == (None, "Post-Monsoon")


def test_filters(spark):
    df = make(
        spark,
        {"city": "A", "date": dt.date(2021, 1, 1), "severity_label": "Minor"},
        {"city": "B", "date": dt.date(2021, 1, 2), "vehicle_type": "Bus"},
        {"city": "A", "date": dt.date(2021, 1, 3)},
    )
    assert filters.filter_incidents(df).count() == 3
    assert filters.filter_incidents(df, "All Cities", None, [], []).count() == 3
    assert filters.filter_incidents(df, "A").count() == 2
    assert filters.filter_incidents(df, "'; DROP TABLE x --").count() == 0
    assert filters.filter_incidents(df, None, (dt.date(2021, 1, 2), dt.date(2021, 1, 3))).count() == 2
    assert filters.filter_incidents(df, severities=["Minor"]).count() == 1
    assert filters.filter_incidents(df, vehicles=["Bus"]).count() == 1


def test_sample_is_bounded_and_repeatable(spark, incidents):
    one = [r.accident_id for r in filters.sample_rows(incidents, 50).collect()]
    two = [r.accident_id for r in filters.sample_rows(incidents.repartition(5), 50).collect()]
    assert len(one) == 50 and sorted(one) == sorted(two)
    assert filters.sample_rows(incidents.limit(3), 50).count() == 3


def test_filter_options_with_nulls(spark):
    df = make(spark, {"city": None, "date": None}, {"city": "A"}, {"city": "B", "vehicle_type": "Bus"})
    rows = [(r.option, r.value) for r in filters.filter_options(df).collect()]
    assert [v for o, v in rows if o == "city"] == ["A", "B"]
    assert [v for o, v in rows if o == "vehicle_type"] == ["Bus", "Car"]
    assert ("min_date", "2021-03-18") in rows and ("max_date", "2021-03-18") in rows


def test_cluster_counts_add_up(spark, incidents):
    clusters = spatial.spatial_clusters(incidents, min_incidents=1)
    assert clusters.agg(F.sum("accident_count")).first()[0] == incidents.count()
    assert spatial.spatial_clusters(incidents).where("accident_count < 3").count() == 0


def test_rows_without_cell_are_left_out(spark):
    gone = {"latitude": None}
    df = make(spark, {}, {}, {}, gone, gone, gone, gone)
    (row,) = spatial.spatial_clusters(df).collect()
    assert row.accident_count == 3 and row.cluster_center.lat == 18.5
    assert [r.accidents for r in spatial.cell_top(df).collect()] == [3]
    assert [r.cell_density for r in spatial.cell_density(df).collect()] == [3]
    assert [r.accident_count for r in spatial.cell_profile(df).collect()] == [3]
    assert [r.accident_count for r in spatial.city_top_cells(df).collect()] == [3]


def test_neighbor_density(spark):
    base = make(spark, {}).select("cell").first().cell
    df = spark.createDataFrame([(base,)] * 4 + [(base + 1,)] * 3 + [(base + 50,)], "cell long")
    got = {r.cell - base: (r.cell_density, r.neighbor_density) for r in spatial.cell_density(df).collect()}
    assert got == {0: (4, 1.0), 1: (3, 1.0), 50: (1, 1 / 7)}


def test_grid_size_is_a_parameter(spark):
    near = [{"latitude": 18.5 + 0.001 * i} for i in range(6)]
    df = make(spark, *near)
    assert [r.max_nearby_accidents for r in spatial.grid_hotspots(df).collect()] == [5]
    assert [r.max_nearby_accidents for r in spatial.grid_hotspots(df, 10).collect()] == [6]
    assert spatial.grid_hotspots(df, 1000).count() == 0


def test_profile_modes_take_the_smallest_on_a_tie(spark):
    df = make(
        spark, {"hour": 9, "vehicle_type": "Car"}, {"hour": 8, "vehicle_type": "Bus"},
        {"hour": 9, "vehicle_type": "Bus"}, {"hour": 8, "vehicle_type": "Car"},
    )
    (row,) = spatial.cell_profile(df).collect()
    assert (row.common_hour, row.common_vehicle, row.is_hotspot, row.density_score) == (8, "Bus", 1, 1.0)


def test_profile_quantile_is_interpolated(spark):
    step = 0.05
    changes = [{"latitude": 18.0 + step * i} for i, n in enumerate([1, 2, 3, 10]) for _ in range(n)]
    rows = spatial.cell_profile(make(spark, *changes)).collect()
    # the 0.8 quantile of 1, 2, 3, 10 is 3 + 0.4 * 7 = 5.8
    assert sorted((r.accident_count, r.is_hotspot) for r in rows) == [(1, 0), (2, 0), (3, 0), (10, 1)]


def test_road_risk(spark):
    df = make(spark, *[{"severity": s, "fatalities": int(s == 3)} for s in (1, 1, 2, 2, 3)])
    (row,) = risk.road_risk_scores(df).collect()
    assert (row.accident_count, row.avg_severity, row.total_fatalities, row.risk_score) == (5, 1.8, 1, 2.4)
    assert risk.road_risk_scores(df.limit(4)).count() == 0


def test_risk_factors_equal_three_aggregates(spark, incidents):
    got = {(r.factor, r.value): (r.accident_count, r.avg_severity) for r in risk.risk_factors(incidents).collect()}
    for column in risk.RISK_FACTORS:
        for r in incidents.groupBy(column).agg(F.count("*").alias("n"), F.avg("severity").alias("s")).collect():
            assert got.pop((column, r[column])) == (r.n, r.s)
    assert not got


def test_averages_leave_out_null_severity(spark):
    df = make(spark, {"severity": 1}, {"severity": None}, {"severity": 3, "fatalities": 1})
    assert summary.global_stats(df).first().avg_severity == 2.0
    assert risk.road_risk_scores(df, 1).first().risk_score == 3.0
    assert {r.avg_severity for r in risk.risk_factors(df).collect()} == {2.0}


def test_empty_input(spark):
    df = make(spark, {}).where("false")
    stats = summary.global_stats(df).first()
    assert (stats.total_accidents, stats.avg_severity) == (0, None)
    kpis = summary.overview_kpis(df, dt.datetime(2021, 4, 1)).first()
    assert (kpis.total_accidents, kpis.fatal_percent) == (0, None)
    assert risk.risk_metrics(df, F.lit(True)).first().fatality_rate is None
    assert summary.insights(df).count() == 0
    assert spatial.cell_profile(df).count() == 0


def test_recency_is_strict(spark):
    as_of = dt.datetime(2021, 4, 17, 9, 30, 5)
    df = make(spark, {}, {"accident_datetime": dt.datetime(2021, 3, 18, 9, 30, 6)})
    assert summary.overview_kpis(df, as_of).first().recent_accidents == 1


def test_summary_counts_road_types_for_cities(spark):
    df = make(spark, {"city": "A"}, {"city": "A", "road_type": "City Road"}, {"city": "B"})
    rows = [(r.category, r.total_accidents, r.cities_covered) for r in summary.insights_summary(df).collect()]
    assert rows == [("Total Analysis", 3, 2), ("City: A", 2, 2), ("City: B", 1, 1)]


def test_analysis_type(spark, incidents):
    assert temporal.temporal_analysis(incidents, "daily").columns[0] == "day_of_week"
    with pytest.raises(ValueError):
        temporal.temporal_analysis(incidents, "weekly")


def test_rounding_of_city_means_is_half_even(spark):
    severities = [1] * 7 + [2]  # mean 1.125
    df = make(spark, *[{"severity": s} for s in severities])
    assert summary.city_comparison(df).first().avg_severity == 1.12
    assert risk.severity_view(df).first().avg_severity == 1.13


def test_pivot_is_zero_filled(spark):
    df = make(spark, {"severity_label": "Minor"}, {"vehicle_type": "Bus"})
    rows = {r.vehicle_type: (r.Minor, r.Serious, r.Fatal) for r in risk.vehicle_severity_pivot(df).collect()}
    assert rows == {"Bus": (0, 1, 0), "Car": (1, 0, 0)}


def test_insights_ties_and_single_weather(spark):
    df = make(spark, {"hour": 9, "severity": 1}, {"hour": 8, "vehicle_type": "Bus", "severity": 1})
    rows = {r.title: r.message for r in summary.insights(df).collect()}
    assert rows["Peak Hour Alert"].startswith("Hour 8:00 has the highest accident rate (1 accidents)")
    assert "on Bus and Car drivers" in rows["Vehicle Safety Focus"]
    assert "Fatal Accident Hotspots" not in rows and "Weather-Based Prevention" not in rows


def test_city_report(spark):
    df = make(
        spark,
        {"city": "A", "severity": 3, "fatalities": 1, "road_type": "Highway", "hour": 8},
        {"city": "A", "severity": 3, "road_type": "City Road", "hour": 9, "month": 4},
        {"city": "B", "severity": 1, "hour": 12},
    )
    a, b = reports.city_risk_reports(df).orderBy("city").collect()
    assert (a.total_accidents, a.peak_accident_hour, a.riskiest_road_type) == (2, 8, "City Road")
    assert a.fatality_rate == 50.0 and a.seasonal_pattern == {3: 1, 4: 1}
    assert [r.split(":")[0] for r in a.recommendations] == ["CRITICAL", "HIGH", "MEDIUM"]
    assert "peak at 8:00" in a.recommendations[2]
    assert [h.accident_count for h in a.top_hotspots] == [2]
    assert b.recommendations == []
    assert reports.city_risk_reports(df, "nowhere").count() == 0


def test_report_compares_hours_as_numbers(spark):
    df = make(spark, {"hour": 10, "month": 12}, {"hour": 9, "month": 2})
    row = reports.city_risk_reports(df).first()
    assert row.peak_accident_hour == 9 and row.seasonal_pattern == {2: 1, 12: 1}


def test_risk_level_bounds(spark):
    scores = [1.0, 1.4999, 1.5, 2.1999, 2.2, 2.6999, 2.7, 3.0, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert [r[0] for r in df.select(rules.risk_level(F.col("s"))).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", "HIGH", "CRITICAL", "CRITICAL", None,
    ]


def test_trip_advice_default(spark):
    df = spark.createDataFrame(
        [("LOW", 10, "Clear", "Car", "City Road"), ("HIGH", 7, "Fog", "Bicycle", "Highway")],
        "l string, h int, w string, v string, r string",
    )
    quiet, full = [
        r[0] for r in df.select(rules.trip_advice(*[F.col(c) for c in "lhwvr"])).collect()
    ]
    assert quiet == ["Relatively safe conditions - maintain standard safety practices"]
    assert len(full) == 5


def test_infrastructure_rules(spark):
    df = make(spark, *[{"severity": 3, "fatalities": 1} for _ in range(11)])
    row = summary.infrastructure_recommendations(df).first()
    assert row.recommendations == [
        "Install speed cameras", "Add median barriers", "Improve emergency response", "Traffic signal optimization",
    ]


def test_marginals_cover_all_rows(spark, incidents):
    n = incidents.count()
    rows = marginals(incidents, ["hour", "city"]).groupBy("factor").agg(F.sum("n").alias("n")).collect()
    assert {r.factor: r.n for r in rows} == {"hour": n, "city": n}


BAD = {
    "accident_id": {"accident_id": None}, "city": {"city": None}, "state": {"state": None},
    "latitude": {"latitude": None}, "longitude": {"longitude": None},
    "accident_datetime": {"accident_datetime": None}, "date": {"date": None}, "time": {"time": None},
    "hour": {"hour": 24}, "day_of_week": {"day_of_week": 7}, "month": {"month": 0}, "year": {"year": 1999},
    "severity": {"severity": 4},
}


def test_each_rule_has_its_reason(spark):
    df = make(spark, *BAD.values(), {}, {"hour": None, "severity": None}, cell=False)
    rows = quality.with_reasons(df).collect()
    for name, row in zip(BAD, rows):
        assert len(row.reasons) == 1 and row.reasons[0].startswith(name)
    assert rows[-2].reasons == [] and rows[-1].reasons == []
    assert quality.valid_rows(df).count() == 2 and quality.quarantine(df).count() == len(BAD)
    assert {r["reason"] for r in quality.violation_counts(df).collect()} >= {"hour_range", "city_missing"}


def test_defaults(spark):
    df = make(spark, {"casualties": None, "injured": None}, cell=False)
    row = quality.stamped(quality.incident_defaults(df)).first()
    assert (row.casualties, row.injured) == (0, 0) and row.created_at is not None


def test_deduplicate_keeps_the_newest_and_accounts_for_every_row(spark):
    newer = dt.datetime(2022, 1, 1)
    df = make(
        spark,
        {"accident_id": "X", "city": "old"},
        {"accident_id": "X", "city": "new", "accident_datetime": newer},
        {"accident_id": "X", "city": "new", "accident_datetime": newer},
        {"accident_id": "X", "city": "old"},
        {"accident_id": "Y"},
        {"accident_id": None, "city": "p"},
        {"accident_id": None, "city": "q"},
        cell=False,
    )
    kept, surplus = quality.deduplicate(df)
    assert sorted((r.accident_id or "", r.city) for r in kept.collect() if r.accident_id) == [("X", "new"), ("Y", "Pune")]
    extra = {(r.accident_id, r.city): r.copies for r in surplus.collect() if r.accident_id}
    assert extra == {("X", "new"): 1, ("X", "old"): 2}
    assert kept.count() + surplus.agg(F.sum("copies")).first()[0] == df.count()
    assert quality.duplicate_keys(df).where("accident_id = 'X'").first().copies == 4


def test_deduplicate_chooses_among_equal_times_and_missing_ones(spark):
    t = dt.datetime(2022, 1, 1)
    rows = [("T", t, 1), ("T", t, 2), ("T", t, 2), ("T", None, 9), ("N", None, 1), ("N", None, 1), ("N", None, 3), ("E", t, 5), ("E", t, 5), ("S", None, 4)]
    df = spark.createDataFrame(rows, "accident_id string, accident_datetime timestamp, payload int")
    kept, surplus = quality.deduplicate(df.repartition(5))
    got = [tuple(r) for r in kept.collect()]
    assert sorted(r[0] for r in got) == ["E", "N", "S", "T"] and next(r for r in got if r[0] == "T")[1] == t
    assert Counter(rows) == Counter(got) + Counter({tuple(r)[:3]: r.copies for r in surplus.collect()})
    again = quality.deduplicate(df.repartition(2, "payload"))[0]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in again.collect())  # whatever the order of the rows
    assert [x.count() for x in quality.deduplicate(df.where("false"))] == [0, 0]


def test_winners_are_chosen_without_sorting_rows(spark):
    df = make(spark, {"accident_id": "X"}, {"accident_id": "X"}, cell=False)
    text = quality.deduplicate(df)[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_copies_of_one_content_are_only_counted(spark, monkeypatch):
    """Ids whose rows are equal need no winner, so their rows are not looked up again."""
    kept_apart = {}

    def counted(df, label):
        out = written(df, label)
        kept_apart[label] = out.count()
        return out

    monkeypatch.setattr(quality, "written", counted)
    df = spark.range(900).selectExpr("string(id % 300) accident_id", "timestamp_seconds(id % 300) accident_datetime", "id % 300 payload")
    kept, surplus = quality.deduplicate(df)
    assert kept.count() == 300 and [tuple(r) for r in surplus.groupBy("copies").count().collect()] == [(2, 300)]
    assert kept_apart.pop("contents") == 300 and set(kept_apart.values()) == {0}
    other = spark.createDataFrame([("7", None, -1), (None, None, 1), (None, None, 1)], df.schema)
    kept, surplus = quality.deduplicate(df.unionByName(other))
    assert kept.count() == 302 and surplus.where("payload = -1").first().copies == 1 and kept_apart["lost"] == 1


def test_hot_key_dedupe(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.col("id").cast("string")).alias("accident_id"),
        F.timestamp_seconds(F.col("id")).alias("accident_datetime"), F.col("id").alias("payload"),
    )
    kept, surplus = quality.deduplicate(df)
    assert kept.count() == 2001 and surplus.count() == 999
    assert kept.where("accident_id = 'HOT'").first().payload == 2997


def test_sql_radius_function_is_ordered_and_complete(spark, incidents):
    from kerbwise.operators.radius import within_radius
    from kerbwise.plans.views import register_views

    register_views(spark, incidents)
    for lat, lon, meters in ((19.07, 72.87, 500_000), (89.9, 10.0, 9_000_000)):
        got = spark.sql(f"SELECT * FROM accidents_within_radius({lat}, {lon}, {meters})").collect()
        assert got and got == within_radius(incidents, lat, lon, meters).collect()


def test_sql_function_around_many_centres_is_a_bucket_join(spark, incidents):
    from kerbwise.operators.radius import radius_join
    from kerbwise.plans.views import register_views

    incidents = incidents.select(  # some on both sides of the 180th meridian, some near a pole, some without a place
        *[c for c in incidents.columns if c not in ("latitude", "longitude", "accident_id")],
        F.row_number().over(Window.orderBy("accident_id")).cast("string").alias("accident_id"), "latitude", "longitude",
    ).withColumns({
        "longitude": F.expr("CASE cast(accident_id as int) % 5 WHEN 0 THEN 179.99 + 0.02 * (hour % 2) - 360 * (hour % 2) WHEN 1 THEN NULL ELSE longitude END"),
        "latitude": F.expr("CASE cast(accident_id as int) % 5 WHEN 0 THEN 0.001 * hour WHEN 2 THEN 89.99 ELSE latitude END"),
    })
    register_views(spark, incidents)
    centres = [(1, 0.0, 180.0), (2, 0.01, -179.995), (3, 89.995, 0.0), (4, None, 1.0), (5, 120.0, 10.0), (6, 12.0, 74.0), (7, 12.0, 74.0)]
    around = spark.createDataFrame(centres, "id int, center_lat double, center_lon double")
    around.createOrReplaceTempView("centres")
    for meters in (900, 20_000):
        df = spark.sql(f"SELECT id, a.accident_id, a.distance_meters FROM centres, LATERAL accidents_near(center_lat, center_lon, {meters}) a")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = radius_join(incidents, around.where("abs(center_lat) <= 90"), meters).select("id", "accident_id")
        got = df.select("id", "accident_id")
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count() and got.where("id < 4").count() > 0
    assert spark.sql("SELECT * FROM centres, LATERAL accidents_near(center_lat, center_lon) a").where("id in (4, 5)").count() == 0


def test_places_hold_every_request_in_short_lists(spark, monkeypatch):
    from kerbwise.operators import radius

    monkeypatch.setattr(radius, "PLACE_IDS", 10)
    rows = [(i % 40, 1.0, 2.0) for i in range(95)] + [(None, 1.0, 2.0), (7, None, 2.0), (8, 3.0, None), (9, 3.0, float("nan")), (9, 3.0, float("nan"))]
    df = spark.createDataFrame(rows, "request_id long, latitude double, longitude double").repartition(3)
    places = radius.places_of(df, "request_id")
    back = places.select(F.explode("ids").alias("request_id"), "latitude", "longitude")
    assert back.exceptAll(df).count() == 0 == df.exceptAll(back).count() and places.count() < len(rows) / 2
    assert max(len(r.ids) for r in places.collect()) <= 20


def test_requests_at_one_place_are_searched_for_together(spark, small):
    from kerbwise.plans import registry

    df = registry.sql_radius_requests(spark, small)
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    spread = next(i for i, line in enumerate(lines) if "Generate explode(ids" in line)
    assert spread < next(i for i, line in enumerate(lines) if "Join [" in line)  # above all joins


def test_distances_of_the_table_functions_round_as_decimals_do(spark):
    from kerbwise.plans.views import _METERS

    meters = F.when(F.col("id") % 3 == 0, F.col("id") / 1000.0).when(F.col("id") % 3 == 1, F.col("id") * 0.005).otherwise(F.rand(3) * 2e7)
    spark.range(300_000).select(meters.alias("meters")).createOrReplaceTempView("near")
    assert spark.sql(f"SELECT count_if(NOT ({_METERS} <=> CAST(round(CAST(meters AS DECIMAL(18,8)), 2) AS DOUBLE))) FROM near").first()[0] == 0
    assert spark.sql(f"SELECT {_METERS} FROM (SELECT CAST(NULL AS DOUBLE) AS meters) near").first()[0] is None


def test_training_rows_have_one_layout(spark):
    from pyspark.sql import functions as F

    from kerbwise.learning.models import TRAIN_PARTITIONS, _train

    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit(True).alias("is_train"))
    layout = lambda df: _train(df).select("id", F.spark_partition_id().alias("p")).collect()
    assert layout(rows.repartition(3)) == layout(rows.repartition(11))
    assert max(r.p for r in layout(rows)) < TRAIN_PARTITIONS


def test_partitions_of_training_rows_grow_with_the_rows(spark, monkeypatch):
    from kerbwise.learning import models

    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit(True).alias("is_train"))
    monkeypatch.setattr(models, "PARTITION_ROWS", 250)
    sizes = [n for n in models._train(rows).rdd.glom().map(len).collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * 250
    assert models.train_partitions(0) == models.TRAIN_PARTITIONS == models.train_partitions(8 * 250)


def test_jobs_run_together_and_keep_their_order(spark):
    import threading

    from kerbwise.learning.models import together

    met = threading.Barrier(3, timeout=60)  # no job ends before all have begun
    assert together(spark, [lambda k=k: (met.wait(), spark.range(k).count())[1] for k in (3, 1, 2)]) == [3, 1, 2]
