"""Fixed table schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

INCIDENT_CSV = T.StructType(
    [
        T.StructField("accident_id", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("accident_datetime", T.TimestampNTZType()),
        T.StructField("date", T.DateType()),
        T.StructField("time", T.StringType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("severity_label", T.StringType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("road_type", T.StringType()),
        T.StructField("weather", T.StringType()),
        T.StructField("casualties", T.IntegerType()),
        T.StructField("fatalities", T.IntegerType()),
        T.StructField("injured", T.IntegerType()),
    ]
)

INCIDENT_COLUMNS = INCIDENT_CSV.fieldNames()

# The text of a CSV line that does not parse; null for the others.
UNPARSED = "unparsed"
CHECKED_CSV = T.StructType([*INCIDENT_CSV.fields, T.StructField(UNPARSED, T.StringType())])

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])

ROADS = T.StructType(
    [
        T.StructField("road_id", T.LongType()),
        T.StructField("osmid", T.LongType()),
        T.StructField("highway", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("maxspeed", T.IntegerType()),
        T.StructField("lanes", T.IntegerType()),
        T.StructField("oneway", T.BooleanType()),
        T.StructField("geometry", T.ArrayType(POINT)),
        T.StructField("city", T.StringType()),
        T.StructField("length_km", T.DecimalType(10, 3)),
    ]
)

# One GeoJSON feature of a road network; property names as in the roads table.
ROAD_FEATURE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "properties",
            T.StructType(
                [
                    T.StructField("road_id", T.LongType()),
                    T.StructField("osmid", T.LongType()),
                    T.StructField("highway", T.StringType()),
                    T.StructField("name", T.StringType()),
                    T.StructField("maxspeed", T.IntegerType()),
                    T.StructField("lanes", T.IntegerType()),
                    T.StructField("oneway", T.BooleanType()),
                    T.StructField("city", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType()))),
                ]
            ),
        ),
    ]
)

ROAD_COLLECTION = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(ROAD_FEATURE))]
)

# name -> schema of the result tables a full analysis run replaces
RESULT_TABLES = {
    "accident_clusters": T.StructType(
        [
            T.StructField("cell", T.LongType()),
            T.StructField("city", T.StringType()),
            T.StructField("state", T.StringType()),
            T.StructField("accident_count", T.LongType()),
            T.StructField("avg_severity", T.DoubleType()),
            T.StructField("total_casualties", T.LongType()),
            T.StructField("total_fatalities", T.LongType()),
            T.StructField("earliest_accident", T.DateType()),
            T.StructField("latest_accident", T.DateType()),
            T.StructField("center_lat", T.DoubleType()),
            T.StructField("center_lon", T.DoubleType()),
            T.StructField("cluster_center_wkt", T.StringType()),
        ]
    ),
    "rush_hour_patterns": T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("hour", T.IntegerType()),
            T.StructField("accident_count", T.LongType()),
            T.StructField("avg_severity", T.DoubleType()),
            T.StructField("time_category", T.StringType()),
        ]
    ),
    "seasonal_patterns": T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("month", T.IntegerType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("accident_count", T.LongType()),
            T.StructField("avg_severity", T.DoubleType()),
            T.StructField("season", T.StringType()),
        ]
    ),
    "road_risk_scores": T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("road_type", T.StringType()),
            T.StructField("vehicle_type", T.StringType()),
            T.StructField("weather", T.StringType()),
            T.StructField("accident_count", T.LongType()),
            T.StructField("avg_severity", T.DoubleType()),
            T.StructField("total_fatalities", T.LongType()),
            T.StructField("risk_score", T.DoubleType()),
        ]
    ),
    "grid_hotspots": T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("center_lat", T.DoubleType()),
            T.StructField("center_lon", T.DoubleType()),
            T.StructField("max_nearby_accidents", T.LongType()),
            T.StructField("hotspot_severity", T.DoubleType()),
            T.StructField("total_fatal_accidents", T.LongType()),
            T.StructField("hotspot_intensity", T.IntegerType()),
        ]
    ),
    "analysis_summary": T.StructType(
        [
            T.StructField("category", T.StringType()),
            T.StructField("total_accidents", T.LongType()),
            T.StructField("cities_covered", T.LongType()),
            T.StructField("avg_severity", T.DoubleType()),
            T.StructField("total_fatalities", T.LongType()),
            T.StructField("total_casualties", T.LongType()),
            T.StructField("analysis_start_date", T.DateType()),
            T.StructField("analysis_end_date", T.DateType()),
        ]
    ),
}
