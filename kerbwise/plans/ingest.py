"""Batch ingest: incident CSV files -> fact table and quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbwise.functions.geo import with_cell
from kerbwise.operators.quality import deduplicate, incident_defaults, parsed, stamped, with_reasons
from kerbwise.session import written
from kerbwise.sources.files import checked_csv, write_incident_table

DUPLICATE = "accident_id_duplicate"


def ingest(rows: DataFrame, fact_path: str, quarantine_path: str) -> None:
    """Split rows into the fact table and the quarantine.

    The typed rows are written once with their reasons; later steps read that
    table, not the text files. Rows that break a rule and surplus copies of an id
    go to the quarantine with their reasons and the number of rows they stand for.
    """
    checked = written(with_reasons(incident_defaults(rows)), "checked")
    sound = parsed(checked).where(F.size("reasons") == 0).drop("reasons")
    kept, surplus = deduplicate(sound)
    write_incident_table(stamped(with_cell(kept)), fact_path)
    rejected = checked.where(F.size("reasons") > 0).withColumn("copies", F.lit(1).cast("long"))
    repeated = surplus.withColumn("reasons", F.array(F.lit(DUPLICATE)))
    rejected.unionByName(repeated, allowMissingColumns=True).write.mode("overwrite").parquet(quarantine_path)


def ingest_csv(
    spark: SparkSession, paths: list[str], fact_path: str, quarantine_path: str
) -> tuple[DataFrame, DataFrame]:
    """Ingest CSV files; returns the stored fact table and quarantine, lines that do not parse included."""
    ingest(checked_csv(spark.read).csv(paths), fact_path, quarantine_path)
    return spark.read.parquet(fact_path), spark.read.parquet(quarantine_path)
