"""File sources and sinks: incident CSV, road GeoJSON, CSV export, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from kerbwise.functions.geo import haversine_m, point, with_cell
from kerbwise.schema import CHECKED_CSV, INCIDENT_COLUMNS, INCIDENT_CSV, ROAD_COLLECTION, ROAD_FEATURE, UNPARSED


def read_incident_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Incident CSV with header. A header or a line that differs from the schema is an error.

    Lines are parsed whole, so that the error does not depend on the columns a query reads.
    """
    return _with_header(spark.read.schema(INCIDENT_CSV)).option("mode", "FAILFAST").csv(list(paths))


def _with_header(reader: DataFrameReader | DataStreamReader) -> DataFrameReader | DataStreamReader:
    return reader.option("header", True).option("enforceSchema", False).option("columnPruning", False)


def checked_csv(reader: DataFrameReader | DataStreamReader) -> DataFrameReader | DataStreamReader:
    """A batch or stream reader of incident CSV that keeps lines which do not parse.

    Such a line has its text in ``unparsed``; the quality rules reject it as ``unparsable``.
    """
    return (
        _with_header(reader.schema(CHECKED_CSV))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", UNPARSED)
    )


def load_incidents(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV scan plus point and grid cell; missing counts become 0."""
    return enrich(read_incident_csv(spark, *paths))


def enrich(df: DataFrame) -> DataFrame:
    """Point and cell of each row, zero for missing counts."""
    counted = df.na.fill(0, ["casualties", "fatalities", "injured"])
    return with_cell(counted).withColumn("geom", point(F.col("longitude"), F.col("latitude")))


def read_incident_csvs_with_origin(spark: SparkSession, folder: str) -> DataFrame:
    """Every CSV below ``folder``; ``dataset`` is the folder each file lies in, ``unparsed`` a line's text if it does not parse."""
    return (
        checked_csv(spark.read)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
        .withColumn("dataset", F.element_at(F.split("_metadata.file_path", "/"), -2))
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write a (filtered) set as CSV with a header, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_incident_csv(df: DataFrame, path: str) -> None:
    """Write the twenty incident columns in file order."""
    export_csv(df.select(INCIDENT_COLUMNS), path)


def write_incident_table(df: DataFrame, path: str) -> None:
    """Fact table: one folder per year, sorted by cell so row groups can be skipped.

    Rows are brought together by year and one-degree square. The rebalance hint
    lets AQE size the partitions: small squares are merged, a square that holds a
    large share of the rows is split, and no sampling pass over the input is run.
    """
    square = F.floor("latitude") * 360 + F.floor("longitude")
    (
        df.withColumn("_square", square)
        .hint("rebalance", F.col("year"), F.col("_square"))
        .sortWithinPartitions("year", "cell")
        .drop("_square")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )


def _road_rows(features: DataFrame) -> DataFrame:
    """GeoJSON features -> rows of the roads table."""
    line = F.transform(
        F.col("f.geometry.coordinates"),
        lambda c: F.struct(F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(1)).alias("lat")),
    )
    rows = features.where(F.col("f.geometry.type") == "LineString").select(
        *[
            F.col(f"f.properties.{name}").alias(name)
            for name in ("road_id", "osmid", "highway", "name", "maxspeed", "lanes")
        ],
        F.coalesce(F.col("f.properties.oneway"), F.lit(False)).alias("oneway"),
        line.alias("geometry"),
        F.col("f.properties.city").alias("city"),
    )
    legs = F.zip_with(
        F.slice("geometry", F.lit(1), F.greatest(F.lit(0), F.size("geometry") - 1)),
        F.slice("geometry", F.lit(2), F.greatest(F.lit(0), F.size("geometry") - 1)),
        lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]),
    )
    length = F.aggregate(legs, F.lit(0.0), lambda total, leg: total + leg)
    return rows.withColumn("length_km", F.round(length / 1000.0, 3).cast("decimal(10,3)"))


def read_road_collections(spark: SparkSession, *paths: str) -> DataFrame:
    """FeatureCollection files, one document per file (a file is not splittable)."""
    documents = spark.read.schema(ROAD_COLLECTION).option("multiLine", True).json(list(paths))
    return _road_rows(documents.select(F.explode("features").alias("f")))


def read_road_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Line-delimited GeoJSON, one feature per line (splittable)."""
    features = spark.read.schema(ROAD_FEATURE).json(list(paths))
    return _road_rows(features.select(F.struct("type", "properties", "geometry").alias("f")))


def write_road_lines(roads: DataFrame, path: str, coordinates: Column | None = None) -> None:
    """Roads as line-delimited GeoJSON, by default from the two points of a segment."""
    if coordinates is None:
        coordinates = F.array(F.array("lon0", "lat0"), F.array("lon1", "lat1"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("road_id", "highway", "city").alias("properties"),
        F.struct(
            F.lit("LineString").alias("type"),
            coordinates.alias("coordinates"),
        ).alias("geometry"),
    )
    roads.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, datasets: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: files, rows, bytes and latest change, from file metadata."""
    parts = [
        df.select(
            F.lit(name).alias("dataset"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
        .groupBy("dataset", "path", "size", "modified")
        .count()
        for name, df in datasets.items()
    ]
    files = parts[0]
    for part in parts[1:]:
        files = files.unionByName(part)
    return files.groupBy("dataset").agg(
        F.count("*").alias("files"),
        F.sum("count").alias("rows"),
        F.sum("size").alias("bytes"),
        F.max("modified").alias("modified"),
    )


def write_manifest(df: DataFrame, path: str) -> None:
    df.withColumn("collected_at", F.current_timestamp()).write.mode("overwrite").json(path)
