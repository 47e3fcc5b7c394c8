"""Incident streams from files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.functions.geo import with_cell
from kerbwise.schema import INCIDENT_COLUMNS
from kerbwise.sources.files import checked_csv
from kerbwise.sources.warehouse import incidents_from_events, table

EVENT_TIME = "reported_at"


def _event_time(column: str) -> Column:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return F.col(column).cast("timestamp")


def csv_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Incident CSV files as they appear in ``folder``; a line that does not parse has its text in ``unparsed``."""
    rows = checked_csv(spark.readStream).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return with_cell(rows).withColumn(EVENT_TIME, _event_time("accident_datetime"))


def event_stream(
    spark: SparkSession, sf_dir: str, path: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Incidents of event files (default: the warehouse's own), joined to its static tables."""
    schema = table(spark, sf_dir, "events").schema
    events = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path or f"{sf_dir}/events*.parquet")
    )
    rows = incidents_from_events(events, spark, sf_dir)
    return with_cell(rows.select(*INCIDENT_COLUMNS, _event_time("ts").alias(EVENT_TIME)))


def report_stream(
    spark: SparkSession, sf_dir: str, path: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """Repeated reports: order lines as a stream, joined to the static incidents."""
    schema = table(spark, sf_dir, "lineitem").schema
    lines = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path or f"{sf_dir}/lineitem*.parquet")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    )
    facts = incidents_from_events(table(spark, sf_dir, "events"), spark, sf_dir)
    return lines.join(facts, F.col("l_orderkey") == F.col("event_id")).select(
        *INCIDENT_COLUMNS,
        _event_time("l_shipdate").alias(EVENT_TIME),
        F.col("l_linenumber").alias("report_line"),
        F.col("l_partkey").alias("report_ref"),
    )
