"""Named queries over a warehouse folder. Every query reads its whole tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise import fixed
from kerbwise.functions import calendar as cal
from kerbwise.functions.geo import cell_text
from kerbwise.functions.rules import risk_level, trip_advice
from kerbwise.learning import encoding, evaluation, models, scoring
from kerbwise.learning import features as feat
from kerbwise.operators import (
    buffered, filters, network, overlay, quality, radius, reports, risk, spatial, summary, temporal,
)
from kerbwise.plans.analysis import refresh_hotspot_table, run_complete_analysis
from kerbwise.plans.ingest import ingest_csv
from kerbwise.plans.views import register_views
from kerbwise.schema import INCIDENT_CSV
from kerbwise.session import new_path, written
from kerbwise.sources import files, synthetic
from kerbwise.sources import warehouse as wh
from kerbwise.sources.facts import FactStore
from kerbwise.sources.results import ResultStore, flatten_points
from kerbwise.streaming import jobs
from kerbwise.streaming import sources as streams

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
AS_OF = dt.datetime(2001, 8, 1)
RADIUS_CENTER = (15.0, 75.5, 5000)
ROAD_DISTANCE_M = 500.0
CENTER_RADIUS_M = 5000.0
DATES = (dt.date(1996, 1, 1), dt.date(1999, 12, 31))
SEVERITIES = ["Serious", "Fatal"]
VEHICLES = ["Car", "Truck", "Bus"]
CITY = "NATION_7"
KNOWN_REGIONS = ["AFRICA", "AMERICA", "EUROPE"]
LATENESS = "1 day"
APPEND_UNTIL = dt.date(1999, 6, 30)
ROAD_SNAP_M, NETWORK_REACH_M = 2000.0, 10_000.0
REPORT_LAG_DAYS, REPORT_BOUND = 30, dt.timedelta(days=10)
# Histograms that a task of the evidence's forests fills in one pass. The default of 256 MB takes a whole level of all trees,
# whose random writes miss the processor's caches. Features are drawn in another order, which the evidence does not tell apart.
EVIDENCE_PASS_MB = 4
LABEL_COLUMNS = ["city", "state", "vehicle_type", "road_type", "weather", "season"]
SCALED = ["latitude", "longitude", "hour", "day_of_week", "month", "severity", "casualties"]

_registry: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registry[function.__name__] = function
    return function


def on_incidents(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Register a query that is a function of the incident fact."""
    _registry[name] = lambda spark, sf_dir: build(wh.incidents(spark, sf_dir))


def stored_incidents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The incident fact (or the columns a query needs) as a written table, for queries that read it several times."""
    return written(wh.incidents(spark, sf_dir).select(*columns or "*"), "incidents")


def queries() -> dict[str, Query]:
    return dict(_registry)


def _joined(column: str, separator: str = " | ") -> Column:
    return F.array_join(column, separator)


# --- sources, sinks ----------------------------------------------------------


@query
def ingest_job(spark, sf_dir):
    raw, fact, rejected = (new_path(spark, f"ingest-{part}") for part in ("raw", "fact", "rejected"))
    files.write_incident_csv(wh.incident_reports(spark, sf_dir), raw)
    facts, quarantine = ingest_csv(spark, [raw], fact, rejected)
    return (
        facts.select(F.lit("fact").alias("target"), F.lit("").alias("reason"), F.lit(1).alias("copies"))
        .unionByName(
            quarantine.select(
                F.lit("quarantine").alias("target"), _joined("reasons").alias("reason"),
                F.col("copies").cast("int").alias("copies"),
            )
        )
        .groupBy("target", "reason")
        .agg(F.sum("copies").alias("row_count"))
    )


@query
def csv_quarantine(spark, sf_dir):
    """Ingest of CSV in which a severity of 3 is written as a word, which does not parse."""
    raw, fact, rejected = (new_path(spark, f"checked-{part}") for part in ("raw", "fact", "rejected"))
    severity = F.when(F.col("severity") == 3, "high").otherwise(F.col("severity").cast("string"))
    files.write_incident_csv(wh.incidents(spark, sf_dir).withColumn("severity", severity), raw)
    facts, quarantine = ingest_csv(spark, [raw], fact, rejected)
    return facts.select("accident_id", F.lit("fact").alias("target"), F.lit("").alias("reason")).unionByName(
        quarantine.select("accident_id", F.lit("quarantine").alias("target"), _joined("reasons").alias("reason"))
    )


@query
def append_ingest(spark, sf_dir):
    """Two batches of reports, by date of report, appended to one fact: where the rows of each id went."""
    store = FactStore(spark, new_path(spark, "fact-store"), buckets=32)
    reports = written(wh.incident_reports(spark, sf_dir), "reports")
    early = F.col("reported_at") <= F.lit(APPEND_UNTIL)
    for part in (early, ~early):
        raw = new_path(spark, "append-raw")
        files.write_incident_csv(reports.where(part), raw)
        store.append_csv(raw)
    facts = store.facts().select(
        "accident_id", "batch", F.lit("fact").alias("target"), F.lit("").alias("reason"), F.lit(1).cast("long").alias("copies")
    )
    rejected = store.quarantine().select(
        "accident_id", "batch", F.lit("quarantine").alias("target"), _joined("reasons").alias("reason"), "copies"
    )
    return facts.unionByName(rejected).groupBy("accident_id", "batch", "target", "reason").agg(F.sum("copies").alias("row_count"))


@query
def csv_roundtrip(spark, sf_dir):
    path = new_path(spark, "incident-csv")
    files.write_incident_csv(wh.incidents(spark, sf_dir), path)
    return files.read_incident_csv(spark, path)


@query
def cell_assign(spark, sf_dir):
    rows = files.enrich(wh.incidents(spark, sf_dir).drop("cell"))
    return rows.select(
        "accident_id", "cell", cell_text(F.col("cell")).alias("cell_name"),
        F.col("geom.lon").alias("geom_lon"), F.col("geom.lat").alias("geom_lat"),
    )


on_incidents("ml_base", filters.model_base)
on_incidents("recent_scan", filters.newest_first)


@query
def results_roundtrip(spark, sf_dir):
    facts = new_path(spark, "incidents")
    files.write_incident_table(wh.incidents(spark, sf_dir), facts)
    store = ResultStore(spark, new_path(spark, "results"))
    tables = run_complete_analysis(spark.read.parquet(facts), store)
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query
def results_contents(spark, sf_dir):
    """The rows of all stored result tables: their keys as one text, and their figures."""
    store = ResultStore(spark, new_path(spark, "results"))
    tables = run_complete_analysis(stored_incidents(spark, sf_dir), store)
    shapes = {  # keys, count, mean severity, two further figures
        "accident_clusters": (["cell", "city", "state", "earliest_accident", "latest_accident"], "accident_count", "avg_severity", "center_lat", "center_lon"),
        "rush_hour_patterns": (["city", "hour", "time_category"], "accident_count", "avg_severity", None, None),
        "seasonal_patterns": (["city", "month", "year", "season"], "accident_count", "avg_severity", None, None),
        "road_risk_scores": (risk.ROAD_KEYS, "accident_count", "avg_severity", "risk_score", "total_fatalities"),
        "grid_hotspots": (["city"], "max_nearby_accidents", "hotspot_severity", "center_lat", "center_lon"),
        "analysis_summary": (["category", "analysis_start_date", "analysis_end_date"], "total_accidents", "avg_severity", "cities_covered", "total_casualties"),
    }
    parts = [
        tables[name].select(
            F.lit(name).alias("table_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("keys"),
            F.col(count).alias("incidents"), F.col(mean).alias("mean_severity"),
            *[(F.col(c) if c else F.lit(None)).cast("double").alias(alias) for c, alias in ((one, "figure"), (two, "other_figure"))],
        )
        for name, (keys, count, mean, one, two) in shapes.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def results_refresh(spark, sf_dir):
    """A result table as a reader loaded it before a refresh, and as it is after it."""
    facts = stored_incidents(spark, sf_dir)
    store = ResultStore(spark, new_path(spark, "published"))
    store.save(risk.road_risk_scores(facts.where("severity < 3")), "road_risk_scores")
    before = store.load("road_risk_scores")
    store.save(risk.road_risk_scores(facts), "road_risk_scores")
    after = store.load("road_risk_scores")
    return before.withColumn("version", F.lit("before")).unionByName(after.withColumn("version", F.lit("after")))


@query
def hotspot_refresh(spark, sf_dir):
    store = ResultStore(spark, new_path(spark, "hotspot-table"))
    return refresh_hotspot_table(wh.incidents(spark, sf_dir), store)


@query
def synthetic_incidents(spark, sf_dir):
    return synthetic.synthesize(wh.table(spark, sf_dir, "events").select("event_id"), "event_id")


@query
def city_state_lookup(spark, sf_dir):
    known = wh.places(spark, sf_dir).where(F.col("state").isin(KNOWN_REGIONS))
    facts = wh.incidents(spark, sf_dir).select("accident_id", "city")
    return synthetic.with_state(facts, known).select("accident_id", "city", "state")


@query
def roads_from_geojson(spark, sf_dir):
    path = new_path(spark, "road-lines")
    files.write_road_lines(wh.roads(spark, sf_dir), path)
    first, last = F.element_at("geometry", 1), F.element_at("geometry", -1)
    return files.read_road_lines(spark, path).select(
        "road_id", "city", "highway", "oneway",
        first["lat"].alias("lat0"), first["lon"].alias("lon0"),
        last["lat"].alias("lat1"), last["lon"].alias("lon1"),
        F.col("length_km").cast("double").alias("length_km"),
    )


@query
def multi_file_csv(spark, sf_dir):
    path = new_path(spark, "yearly-csv")
    facts = wh.incidents(spark, sf_dir).drop("cell")
    (
        facts.withColumn("dataset", F.concat(F.lit("accidents_"), F.col("year").cast("string")))
        .write.partitionBy("dataset").option("header", True).csv(path)
    )
    return (
        files.read_incident_csvs_with_origin(spark, path)
        .groupBy("dataset")
        .agg(
            F.count("*").alias("accident_count"), F.sum("casualties").alias("total_casualties"),
            F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        )
    )


on_incidents("centroid_wkt", lambda df: flatten_points(spatial.spatial_clusters(df)).select(
    "cell", "city", "state", "cluster_center_wkt"
))


@query
def export_csv(spark, sf_dir):
    path = new_path(spark, "export")
    chosen = filters.filter_incidents(
        wh.incidents(spark, sf_dir).drop("cell"), date_range=DATES, severities=SEVERITIES
    )
    files.export_csv(chosen, path)
    return files.read_incident_csv(spark, path)


@query
def export_json(spark, sf_dir):
    path = new_path(spark, "export-json")
    chosen = filters.filter_incidents(wh.incidents(spark, sf_dir).drop("cell"), date_range=DATES, severities=SEVERITIES)
    files.export_json(chosen, path)
    return spark.read.schema(INCIDENT_CSV).json(path)


@query
def source_manifest(spark, sf_dir):
    names = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events"]
    listed = files.manifest(spark, {name: wh.table(spark, sf_dir, name) for name in names})
    return listed.select("dataset", "files", "rows")


# --- quality -----------------------------------------------------------------


@query
def dq_duplicates(spark, sf_dir):
    reports_ = wh.incident_reports(spark, sf_dir)
    return quality.duplicate_keys(reports_, order_by="reported_at")


@query
def dq_deduplicated(spark, sf_dir):
    versions = written(
        wh.incident_reports(spark, sf_dir).select(
            "accident_id", "severity", "casualties", "reported_at", "report_line", "report_ref"
        ),
        "reports",
    )
    kept, surplus = quality.deduplicate(versions, order_by="reported_at")
    both = kept.select("accident_id", "reported_at", F.lit(1).alias("copies"), F.lit(True).alias("is_kept"))
    return (
        both.unionByName(
            surplus.select(
                "accident_id", "reported_at", F.col("copies").cast("int").alias("copies"),
                F.lit(False).alias("is_kept"),
            )
        )
        .groupBy("accident_id")
        .agg(
            F.sum(F.when(F.col("is_kept"), F.col("copies"))).alias("kept"),
            F.max(F.when(F.col("is_kept"), F.col("reported_at"))).alias("kept_at"),
            F.coalesce(F.sum(F.when(~F.col("is_kept"), F.col("copies"))), F.lit(0)).alias("surplus"),
        )
    )


on_incidents("dq_violations", lambda df: quality.quarantine(df).select(
    "accident_id", "year", _joined("reasons").alias("reasons")
))
on_incidents("dq_valid", lambda df: quality.valid_rows(df).select("accident_id", "year"))


@query
def dq_requests(spark, sf_dir):
    return quality.request_reasons(wh.trip_requests(spark, sf_dir)).select(
        "request_id", _joined("reasons").alias("reasons"), (F.size("reasons") == 0).alias("is_valid")
    )


@query
def dq_defaults(spark, sf_dir):
    return quality.request_defaults(wh.trip_requests(spark, sf_dir)).select("request_id", "weather")


# --- filters -----------------------------------------------------------------

on_incidents("filter_incidents", lambda df: filters.filter_incidents(
    df, None, DATES, SEVERITIES, VEHICLES
).select("accident_id", "city", "date", "severity_label", "vehicle_type"))
on_incidents("filter_options", filters.filter_options)
on_incidents("heatmap_points", lambda df: filters.heatmap_points(df, rows=5000).select(
    "accident_id", F.get("point", F.lit(0)).alias("latitude"),
    F.get("point", F.lit(1)).alias("longitude"), F.get("point", F.lit(2)).alias("weight"),
))

# --- aggregations ------------------------------------------------------------

on_incidents("spatial_clusters", lambda df: spatial.spatial_clusters(df).drop("cluster_center"))
on_incidents("cluster_preview", lambda df: spatial.cluster_preview(spatial.spatial_clusters(df), CITY))
on_incidents("hotspot_view", lambda df: spatial.hotspot_view(df).select(
    "*", F.col("centroid.lat").alias("centroid_lat"), F.col("centroid.lon").alias("centroid_lon")
).drop("centroid"))
on_incidents("rush_hour", temporal.rush_hour_patterns)
on_incidents("rush_hour_strict", lambda df: temporal.rush_hour_patterns(df, strict_reference=True))
on_incidents("seasonal", temporal.seasonal_patterns)
on_incidents("temporal_view", temporal.temporal_view)
on_incidents("road_risk", risk.road_risk_scores)
on_incidents("grid_hotspots", spatial.grid_hotspots)
on_incidents("severity_view", risk.severity_view)
on_incidents("global_stats", lambda df: summary.global_stats(df).select(
    "*", F.col("date_range.start").alias("start_date"), F.col("date_range.end").alias("end_date")
).drop("date_range"))
on_incidents("temporal_hourly", lambda df: temporal.temporal_analysis(df, "hourly"))
on_incidents("temporal_daily", lambda df: temporal.temporal_analysis(df, "daily"))
on_incidents("temporal_monthly", lambda df: temporal.temporal_analysis(df, "monthly", CITY))
on_incidents("risk_factors", risk.risk_factors)
on_incidents("cities", summary.cities)
on_incidents("overview_kpis", lambda df: summary.overview_kpis(df, AS_OF))
on_incidents("hourly_counts", temporal.hourly_counts)
on_incidents("monthly_trend", temporal.monthly_trend)
on_incidents("severity_distribution", risk.severity_distribution)
on_incidents("vehicle_severity_pivot", risk.vehicle_severity_pivot)
on_incidents("city_comparison", lambda df: summary.city_comparison(df, 10))
on_incidents("cell_top5", spatial.cell_top)
on_incidents("rush_rollup", lambda df: temporal.rush_rollup(temporal.rush_hour_patterns(df)))
on_incidents("season_rollup", lambda df: temporal.season_rollup(temporal.seasonal_patterns(df)))
on_incidents("risk_by_road", lambda df: risk.mean_risk_by(risk.road_risk_scores(df), "road_type"))
on_incidents("risk_by_weather", lambda df: risk.mean_risk_by(risk.road_risk_scores(df), "weather"))
on_incidents("risk_metrics", lambda df: risk.risk_metrics(df, F.col("vehicle_type").isin(VEHICLES)))
on_incidents("infrastructure_recs", lambda df: summary.infrastructure_recommendations(df).withColumn(
    "recommendations", _joined("recommendations", ", ")
))
on_incidents("city_report", lambda df: reports.city_risk_reports(df).select(
    "city", "total_accidents", "fatal_accidents", "avg_severity", "total_casualties", "fatality_rate",
    "peak_accident_hour", "riskiest_road_type", "riskiest_vehicle_type",
    _joined("recommendations").alias("recommendations"),
    F.array_join(
        F.transform(
            F.map_entries("seasonal_pattern"),
            lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")),
        ),
        ",",
    ).alias("seasonal_pattern"),
    F.array_join(
        F.transform(
            "top_hotspots",
            lambda h: F.concat_ws(":", h["cell"].cast("string"), h["accident_count"].cast("string")),
        ),
        ",",
    ).alias("top_hotspots"),
))
on_incidents("city_month_counts", reports.city_month_counts)
on_incidents("city_top_cells", spatial.city_top_cells)
on_incidents("city_stats", lambda df: summary.city_stats(df).withColumn(
    "city_severity_std", F.round("city_severity_std", 6)
))
on_incidents("cell_profile", spatial.cell_profile)
on_incidents("insights", summary.insights)
on_incidents("hourly_city_stats", temporal.hourly_city_stats)
on_incidents("relative_risk", lambda df: risk.relative_risk(df).withColumn(
    "relative_risk", F.round("relative_risk", 6)
))
on_incidents("insights_summary", summary.insights_summary)
on_incidents("top_hotspots", lambda df: spatial.top_hotspots(spatial.hotspot_view(df)))

# --- joins -------------------------------------------------------------------


@query
def features(spark, sf_dir):
    return feat.feature_table(stored_incidents(spark, sf_dir)).withColumn(
        "city_severity_std", F.round("city_severity_std", 6)
    )


on_incidents("neighbor_density", spatial.cell_density)
on_incidents("within_radius", lambda df: radius.within_radius(df, *RADIUS_CENTER))


@query
def radius_join(spark, sf_dir):
    centers = wh.roads(spark, sf_dir).select(
        "road_id", F.col("lat0").alias("center_lat"), F.col("lon0").alias("center_lon")
    )
    return radius.incidents_around(wh.incidents(spark, sf_dir), centers, "road_id", CENTER_RADIUS_M)


@query
def hotspot_requests(spark, sf_dir):
    hotspots = spatial.hotspot_view(wh.incidents(spark, sf_dir))
    return radius.hotspots_near(wh.trip_requests(spark, sf_dir), hotspots)


@query
def road_match(spark, sf_dir):
    return radius.match_roads(wh.incidents(spark, sf_dir), wh.roads(spark, sf_dir), ROAD_DISTANCE_M)


@query
def road_line_match(spark, sf_dir):
    """Incidents matched to many-point road lines read back from GeoJSON: each road through its middle."""
    path = new_path(spark, "road-lines")
    ends = [F.array("lon0", "lat0"), F.array("lon1", "lat1")]
    middle = F.array((F.col("lon0") + F.col("lon1")) / 2, (F.col("lat0") + F.col("lat1")) / 2)
    files.write_road_lines(wh.roads(spark, sf_dir), path, F.array(ends[0], middle, ends[1]))
    lines = files.read_road_lines(spark, path)
    return radius.match_roads(wh.incidents(spark, sf_dir), radius.segments_of(lines), ROAD_DISTANCE_M)


@query
def road_segment_risk(spark, sf_dir):
    return radius.road_segment_risk(
        wh.incidents(spark, sf_dir), wh.roads(spark, sf_dir), ROAD_DISTANCE_M
    )


@query
def sql_within_radius(spark, sf_dir):
    """The radius search as a table function of SQL."""
    register_views(spark, wh.incidents(spark, sf_dir))
    lat, lon, reach = RADIUS_CENTER
    return spark.sql(f"SELECT * FROM accidents_within_radius({lat}, {lon}, {reach})")


@query
def sql_radius_requests(spark, sf_dir):
    """The incidents around every request: the table function called for many rows.

    It is called for places, each with the ids of its requests, so what a place finds is worked out once. Places are
    written, so that their real size decides whether the rows found are shuffled to meet them.
    """
    register_views(spark, stored_incidents(spark, sf_dir))
    requests = wh.trip_requests(spark, sf_dir).select("request_id", "latitude", "longitude")
    radius.places_of(requests, "request_id").createOrReplaceTempView("request_places")
    return spark.sql(
        "SELECT explode(r.ids) AS request_id, a.accident_id, a.city, a.severity, a.distance_meters FROM request_places r, "
        f"LATERAL accidents_near(r.latitude, r.longitude, {CENTER_RADIUS_M}) a"
    )


@query
def road_cells(spark, sf_dir):
    return overlay.road_cells(wh.roads(spark, sf_dir)).withColumn("length_m", F.round("length_m", 3))


@query
def road_cell_risk(spark, sf_dir):
    return overlay.cell_road_risk(wh.incidents(spark, sf_dir), wh.roads(spark, sf_dir))


@query
def road_network_risk(spark, sf_dir):
    found = network.network_risk(
        wh.incidents(spark, sf_dir), wh.roads(spark, sf_dir), ROAD_SNAP_M, NETWORK_REACH_M, ROAD_DISTANCE_M
    )
    return found.withColumn("network_risk", F.round("network_risk", 6))


@query
def buffered_hotspots(spark, sf_dir):
    found = buffered.buffered_hotspots(wh.incidents(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c in ("center_lat", "center_lon")})


@query
def unseen_categories(spark, sf_dir):
    columns = ["city", "vehicle_type", "road_type", "weather"]
    encoders = encoding.fit_encoders(wh.incidents(spark, sf_dir), columns)
    return encoding.unseen_values(wh.trip_requests(spark, sf_dir), encoders, columns)


# --- scalar rules ------------------------------------------------------------

on_incidents("time_features", lambda df: temporal.time_features(df).select(
    "accident_id", "is_weekend", "is_rush_hour", "is_night", "season",
    cal.day_type(F.col("day_of_week")).alias("day_type"),
    cal.time_category(F.col("hour")).alias("time_category"),
    cal.time_category(F.col("hour"), cal.WAREHOUSE_WINDOWS).alias("warehouse_category"),
))
on_incidents("risk_level", lambda df: (
    df.groupBy("cell")
    .agg(F.count("cell").alias("n"), F.avg("severity").alias("risk_score"))
    .where(F.col("n") > 0)
    .drop("n")
    .withColumn("risk_level", risk_level(F.col("risk_score")))
))
on_incidents("trip_advice", lambda df: df.select(
    "accident_id",
    F.array_join(
        trip_advice(
            risk_level(F.col("severity").cast("double")), F.col("hour"), F.col("weather"),
            F.col("vehicle_type"), F.col("road_type"),
        ),
        " | ",
    ).alias("advice"),
))

# --- learning ----------------------------------------------------------------

on_incidents("label_encode", lambda df: encoding.fit_encoders(
    temporal.time_features(df), LABEL_COLUMNS
))
on_incidents("label_codes", lambda df: encoding.encode(
    df, encoding.fit_encoders(df, ["city", "vehicle_type"]), ["city", "vehicle_type"]
).select("accident_id", "city_encoded", "vehicle_type_encoded"))


@query
def standardize(spark, sf_dir):
    df = stored_incidents(spark, sf_dir, "accident_id", *SCALED)
    scaled = encoding.scale(df, encoding.fit_scaler(df, SCALED))
    return scaled.select("accident_id", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in SCALED])


@query
def stratified_split(spark, sf_dir):
    df = stored_incidents(spark, sf_dir, "accident_id", "severity")
    return encoding.stratified_split(df, "accident_id", "severity")


def _guesses(df: DataFrame) -> DataFrame:
    """A fixed rule as prediction, so that the metrics have something to measure."""
    guess = F.when(F.col("casualties") >= 4, 2).when(F.col("casualties") >= 3, 1).otherwise(0)
    return df.select((F.col("severity") - 1).alias("label"), guess.alias("prediction"))


on_incidents("classification_report", lambda df: evaluation.classification_report(
    _guesses(df), models.CLASS_NAMES
).select(
    "class", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
))
on_incidents("regression_metrics", lambda df: evaluation.regression_metrics(
    df.select(F.col("casualties").alias("label"), F.col("severity").alias("prediction"))
).select("n", F.round("mse", 6).alias("mse"), F.round("r2", 6).alias("r2")))


# Training runs use the settings of the library.


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.feature_table(stored_incidents(spark, sf_dir))


def _predictions(model: models.FittedModel, matrix: DataFrame, key: str) -> DataFrame:
    return model.apply(matrix).select(key, "label", "prediction", "is_train")


@query
def severity_predictions(spark, sf_dir):
    return _predictions(*models.train_severity_model(_features(spark, sf_dir)), "accident_id")


@query
def severity_boosted(spark, sf_dir):
    return _predictions(*models.train_severity_model(_features(spark, sf_dir), "boosted"), "accident_id")


@query
def severity_report(spark, sf_dir):
    return models.severity_report(*models.train_severity_model(_features(spark, sf_dir)))


@query
def cv_results(spark, sf_dir):
    _, _, results = models.tune_severity_model(_features(spark, sf_dir))
    names = {"numTrees": "trees", "maxDepth": "depth", "featureSubsetStrategy": "features", "subsamplingRate": "sample"}
    return results.select(*[F.col("params")[name].alias(alias) for name, alias in names.items()], "accuracy")


@query
def hotspot_predictions(spark, sf_dir):
    profiles = spatial.cell_profile(wh.incidents(spark, sf_dir))
    return _predictions(*models.train_hotspot_model(profiles), "cell")


@query
def casualty_predictions(spark, sf_dir):
    return _predictions(*models.train_casualty_model(_features(spark, sf_dir)), "accident_id")


@query
def feature_importance(spark, sf_dir):
    return models.train_severity_model(_features(spark, sf_dir))[0].importance()


def _scored(spark: SparkSession, sf_dir: str, past: feat.History, model: models.FittedModel) -> DataFrame:
    scored = scoring.score_requests(wh.trip_requests(spark, sf_dir), model, past, AS_OF.date())
    return scored.select(
        "request_id", "predicted_severity", "risk_score", "risk_level",
        _joined("recommendations").alias("recommendations"), "cell", _joined("reasons").alias("reasons"),
        *[
            F.col("severity_probabilities")[name].alias(f"p_{name.lower()}")
            for name in fixed.SEVERITY_LABELS.values()
        ],
    )


@query
def score_batch(spark, sf_dir):
    facts = stored_incidents(spark, sf_dir)
    past = feat.history(temporal.time_features(filters.model_base(facts)))
    model, _ = models.train_severity_model(feat.feature_table(facts, past))
    return _scored(spark, sf_dir, past, model)


def _tally(df: DataFrame, subject: str, part: Column, label: Column, sound: Column) -> DataFrame:
    return df.groupBy(F.lit(subject).alias("subject"), part.alias("part"), label.cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("unsound")
    )


@query
def learning_evidence(spark, sf_dir):
    """What can be said of the models' output beforehand: rows by side of the split and label, and how many are unsound.

    Sound are classes that agree with their probabilities, which sum to 1; casualties inside the range of the
    training rows; predictions of a saved and reloaded model that equal the first ones; scores that follow from their
    probabilities; importances that sum to 1; and five top features that no other one exceeds.
    """
    facts = stored_incidents(spark, sf_dir)
    past = feat.history(temporal.time_features(filters.model_base(facts)))
    rows = feat.feature_table(facts, past)
    side = F.when(F.col("is_train"), "train").otherwise("test")
    shares = vector_to_array("probability")
    agrees = (F.abs(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9) & (
        F.get(shares, F.col("prediction").cast("int")) == F.array_max(shares)
    )

    def forests():
        return models.train_severity_model(rows, maxMemoryInMB=EVIDENCE_PASS_MB), models.train_casualty_model(rows, maxMemoryInMB=EVIDENCE_PASS_MB)

    def boosted():
        return models.train_hotspot_model(spatial.cell_profile(facts))

    # the boosted model's many small jobs fill the gaps between the forests' passes
    ((severity, matrix), (casualty, amounts)), (hotspot, cells) = models.together(spark, [forests, boosted])
    first = severity.apply(matrix)
    folder = new_path(spark, "model")
    severity.save(folder)
    again = models.FittedModel.load(spark, folder).apply(matrix).select("accident_id", F.col("prediction").alias("again"))
    reloaded = first.join(again, "accident_id")
    limits = amounts.where("is_train").agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    scored = _scored(spark, sf_dir, past, severity)
    names = [F.col(f"p_{name.lower()}") for name in fixed.SEVERITY_LABELS.values()]
    expected = sum((p * (k + 1.0) for k, p in enumerate(names)), F.lit(0.0))
    best = F.array_position(F.array(*names), F.greatest(*names))
    valid = F.col("reasons") == ""
    follows = (F.abs(F.col("risk_score") - expected) < 1e-9) & (F.col("predicted_severity") == best) & (
        F.col("risk_level") == risk_level(expected)
    )
    importance = severity.importance().agg(F.sum("importance").alias("total"), F.count("*").alias("n"))
    ordered = severity.importance().agg(F.sort_array(F.collect_list(F.struct(-F.col("importance"), "feature"))))  # one row per feature
    top = severity.top_features()
    named = F.get(ordered.scalar(), F.col("position") - 1)["feature"] == F.col("feature")
    parts = [
        _tally(top, "top features", F.lit("all"), F.lit(0), named & F.col("feature").isin(severity.features)),
        _tally(first, "severity", side, F.col("label"), agrees),
        _tally(reloaded, "reload", F.lit("all"), F.lit(0), F.col("again") == F.col("prediction")),
        _tally(hotspot.apply(cells), "hotspot", side, F.col("label"), agrees),
        _tally(casualty.apply(amounts), "casualty", side, F.lit(0), F.col("prediction").between(*limits)),
        _tally(scored, "score", F.when(valid, "valid").otherwise("rejected"), F.lit(0), F.when(valid, follows).otherwise(F.col("risk_score").isNull())),
        importance.select(
            F.lit("importance").alias("subject"), F.lit("all").alias("part"), F.lit(0).cast("long").alias("label"), "n",
            F.when(F.abs(F.col("total") - 1) < 1e-9, 0).otherwise(1).cast("long").alias("unsound"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def scoring_features(spark, sf_dir):
    past = feat.history(filters.model_base(stored_incidents(spark, sf_dir)))
    rows = scoring.request_features(wh.trip_requests(spark, sf_dir), past, AS_OF.date())
    return rows.select(
        "request_id", "cell_density", F.round("neighbor_density", 6).alias("neighbor_density"),
        "city_avg_severity", F.round("city_severity_std", 6).alias("city_severity_std"),
        "city_avg_casualties", "road_type_risk", "vehicle_type_risk", "is_weekend", "season",
    )


# --- streaming ---------------------------------------------------------------


def _drain(spark: SparkSession, start: Callable[[str, str], object], label: str) -> str:
    """Run a stream until its input is used up; returns the output folder."""
    folder = new_path(spark, label)
    start(f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


@query
def stream_ingest(spark, sf_dir):
    rows = streams.event_stream(spark, sf_dir)
    out = _drain(spark, lambda o, c: jobs.ingest(rows, o, c), "ingest")
    return jobs.read_ingested(spark, out).select(
        "accident_id", "cell", "is_valid", _joined("reasons").alias("reasons")
    )


@query
def stream_dedupe(spark, sf_dir):
    rows = streams.report_stream(spark, sf_dir)
    out = _drain(
        spark, lambda o, c: jobs.write_deduplicated(rows, o, c, "3650 days"), "dedupe"
    )
    return spark.read.parquet(out).select("accident_id", "city", "severity")


@query
def stream_timely(spark, sf_dir):
    """Reports that arrive some days after their date, a year's arrivals in each batch: first copies and late rows."""
    folder = new_path(spark, "arrivals")
    lines = wh.table(spark, sf_dir, "lineitem")
    arrived = F.year(F.date_add(F.to_date("l_shipdate"), (F.col("l_partkey") % REPORT_LAG_DAYS).cast("int")))
    for row in lines.select(arrived.alias("year")).distinct().orderBy("year").collect():
        lines.where(arrived == row["year"]).repartition(1).write.mode("append").parquet(folder)
    rows = streams.report_stream(spark, sf_dir, folder, files_per_batch=1).select("accident_id", streams.EVENT_TIME, "report_line")
    store = _drain(spark, lambda o, c: jobs.deduplicate_timely(rows, o, c, REPORT_BOUND), "timely")
    parts = [spark.read.parquet(f"{store}/{t}").select("accident_id", "report_line", F.lit(t).alias("target")) for t in ("first", "late")]
    return parts[0].unionByName(parts[1])


@query
def stream_hotspots(spark, sf_dir):
    rows = streams.event_stream(spark, sf_dir)
    store = _drain(spark, lambda o, c: jobs.refresh_hotspots(rows, o, c), "hotspots")
    return jobs.current_hotspots(spark, store).select(
        "*", F.col("centroid.lat").alias("centroid_lat"), F.col("centroid.lon").alias("centroid_lon")
    ).drop("centroid")


@query
def stream_hotspots_folded(spark, sf_dir):
    """Hotspots of events that arrive in six files, by time: three batches, folded and removed, then three more."""
    folder, arrivals = new_path(spark, "hotspots"), new_path(spark, "event-files")
    events = wh.table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    sixths = events.select(F.percentile_approx(at, [k / 6 for k in range(1, 6)])).first()[0]  # a sketch of fixed size
    part = sum((F.coalesce(at > F.lit(x), F.lit(False)).cast("int") for x in sixths or []), F.lit(0))
    parts = written(events.withColumn("_part", part), "event-parts")
    for half in (range(3), range(3, 6)):
        for k in half:
            parts.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(arrivals)
        rows = streams.event_stream(spark, sf_dir, arrivals, files_per_batch=1)
        jobs.refresh_hotspots(rows, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        if half.start == 0:
            jobs.compact_hotspots(spark, f"{folder}/out")
            jobs.retire_hotspots(spark, f"{folder}/out", dt.timedelta(0))
    return jobs.current_hotspots(spark, f"{folder}/out").select(
        "*", F.col("centroid.lat").alias("centroid_lat"), F.col("centroid.lon").alias("centroid_lon")
    ).drop("centroid")


@query
def stream_daily_cells(spark, sf_dir):
    rows = streams.event_stream(spark, sf_dir)
    out = _drain(spark, lambda o, c: jobs.write_daily_cells(rows, o, c, LATENESS), "daily")
    return spark.read.parquet(out)
